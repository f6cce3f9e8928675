"""Token counts that follow edits: a tree of pre-token counts per document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.batches import pieces, texts
from postmill.llm.bpe import Encoder, encoder

# Pre-tokens per leaf when a tree is built; a leaf that edits made larger than LEAF_MOST has the tree built anew.
LEAF = 32
LEAF_MOST = 256
# Characters after a pre-token that its pattern may look at: one after its end, two where a contraction is tried.
CONTEXT = 2

Edit = tuple[int, int, str]  # characters from, to, what stands there afterwards


class TokenTree:
    """The pre-tokens of one text with sums of characters and tokens over all subtrees."""

    def __init__(self, text: str, coder: Encoder) -> None:
        self.coder, self.encoded = coder, 0
        self._build(*self._scan(text, len(text), True))

    def _scan(self, text: str, most: int, final: bool) -> tuple[list[str], list[int]]:
        """Pre-tokens of ``text`` that are sure, and their counts; unless ``final`` more text may follow."""
        found, end = [], 0
        for m in self.coder.split.finditer(text):
            if not final and m.end() > most - CONTEXT:
                break
            found.append(m[0])
            end = m.end()
        self.coder.learn(found)
        return found, [len(self.coder.known[t]) // 4 for t in found]

    def _build(self, tokens: list[str], counts: list[int]) -> None:
        n = max(1, -(-len(tokens) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [(tokens[a:a + LEAF], counts[a:a + LEAF]) for a in range(0, max(1, len(tokens)), LEAF)]
        self.leaves += [([], []) for _ in range(self.size - len(self.leaves))]
        self.chars, self.counts = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (part, each) in enumerate(self.leaves):
            self.chars[self.size + i], self.counts[self.size + i] = sum(map(len, part)), sum(each)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.counts[node] = self.counts[2 * node] + self.counts[2 * node + 1]

    def _put(self, leaf: int, tokens: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (tokens, counts)
        node = self.size + leaf
        self.chars[node], self.counts[node] = sum(map(len, tokens)), sum(counts)
        while node > 1:
            node //= 2
            self._sum(node)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end of the text), and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.counts[1]

    def text(self) -> str:
        return "".join(t for tokens, _ in self.leaves for t in tokens)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from ``start`` to ``end`` and mends the counts around.

        Encoding starts at the first pre-token that can see the edit and goes on until it meets a boundary of
        the old pre-tokens behind the edit: what follows a boundary does not depend on what stands before it.
        """
        if not 0 <= start <= end <= self.length:
            raise ValueError("an edit lies outside the text")
        first, begin = self._leaf_at(max(0, start - CONTEXT))
        before: list[str] = []
        kept: list[int] = []
        at = begin
        for token, count in zip(*self.leaves[first], strict=True):
            if at + len(token) > start - CONTEXT:
                break
            before.append(token)
            kept.append(count)
            at += len(token)
        last, behind = self._leaf_at(end)
        behind += self.chars[self.size + last]
        while True:
            old = "".join(t for i in range(first, last + 1) for t in self.leaves[i][0])
            final = behind == self.length
            region = old[at - begin:start - begin] + new + old[end - begin:]
            tokens, counts = self._scan(region, len(region), final)
            if final or (done := self._meets(tokens, region, first, last, begin, at, start, end, len(new))) is not None:
                break
            reach = last
            while last < self.size - 1 and last <= 2 * reach - first:
                last += 1
                behind += self.chars[self.size + last]
        if final:
            tail: tuple[list[str], list[int]] = ([], [])
        else:
            used, tail = done
            tokens, counts = tokens[:used], counts[:used]
        self.encoded += len(tokens)
        tokens, counts = before + tokens + tail[0], kept + counts + tail[1]
        self._put(first, tokens, counts)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf][0]:
                self._put(leaf, [], [])
        if len(tokens) > LEAF_MOST:
            self._build([t for part, _ in self.leaves for t in part], [c for _, part in self.leaves for c in part])

    def _meets(self, tokens: list[str], region: str, first: int, last: int, begin: int, at: int, start: int, end: int,
               new: int) -> tuple[int, tuple[list[str], list[int]]] | None:
        """How many new pre-tokens there are up to the first old boundary behind the edit, and the old ones from there."""
        shift = (end - start) - new
        bounds, position = {}, begin
        for leaf in range(first, last + 1):
            for k, token in enumerate(self.leaves[leaf][0]):
                position += len(token)
                if position >= end:
                    bounds[position] = (leaf, k + 1)
        position = at
        for used, token in enumerate(tokens, 1):
            position += len(token)
            if position >= start + new and position + shift in bounds:
                leaf, k = bounds[position + shift]
                rest = [(self.leaves[leaf][0][k:], self.leaves[leaf][1][k:]), *self.leaves[leaf + 1:last + 1]]
                return used, ([t for part, _ in rest for t in part], [c for _, part in rest for c in part])
        return None


# Redactions: e-mail addresses, IP addresses, long hexadecimal strings and long numbers.
REDACTED = [
    (re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), "[email]"),
    (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)"), "[address]"),
    (re.compile(r"(?<!\w)(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{16,128}(?!\w)"), "[secret]"),
    (re.compile(r"(?<!\w)\d{13,19}(?!\w)"), "[number]"),
]


def redactions(text: str) -> list[Edit]:
    """Edits that redact a text, from its end to its start, so that earlier places stay where they are."""
    found: list[Edit] = []
    for pattern, mark in REDACTED:
        if mark != "[email]" or "@" in text:
            found += [(m.start(), m.end(), mark) for m in pattern.finditer(text)]
    out: list[Edit] = []
    for edit in sorted(found, reverse=True):
        if not out or edit[1] <= out[-1][0]:
            out.append(edit)
    return out


SCHEMA = ("doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded_again long, n_chars_edited long")
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


def counted(docs: DataFrame, path: str, pattern: str, edits: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """SCHEMA per row of ``docs``: tokens of the whole text, its edits, and tokens of the text after them.

    ``edits`` names the edits of a text, in the order in which they are made; places refer to the text as it is then.
    Every pre-token is counted once; a text with edits keeps a tree of these counts, in which each edit has
    only the pre-tokens around it counted again (n_encoded_again in all). Null and empty texts have no tokens and no
    edits. Null and repeated doc_ids are passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in pieces(batches, "text", 1 << 20):
            rows = []
            batch = [t or "" for t in part.column("text").to_pylist()]
            for text, ids in zip(batch, coder.encode_all(batch), strict=True):
                found = edits(text)
                if not found:
                    rows.append((len(ids), 0, len(ids), 0, len(text)))
                    continue
                tree = TokenTree(text, coder)
                for start, end, new in found:
                    tree.replace(start, end, new)
                rows.append((len(ids), len(found), tree.total, tree.encoded, tree.length))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                                             NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)
