"""Named queries over texts and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.masking import mask_pii as mask
from postmill.operators import compound, dedup, messages, spelling, textsteps
from postmill.operators import dictionary as D
from postmill.plans import statements as S
from postmill.plans.queries_messages import records
from postmill.session import shared_dir, written
from postmill.sources import readers, sample

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def documents(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", "text")


def turns(spark, sf):
    key = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return sample.table(spark, sf, "conversations").select(key.alias("turn_id"), "text")


# --- masking -----------------------------------------------------------------------------------

_MASKED = f"SELECT doc_id, {S.mask('text')} AS masked FROM documents"


@query(_MASKED)
def mask_pii(spark, sf):
    return documents(spark, sf).select("doc_id", mask(F.col("text")).alias("masked"))


_CUSTOM = {"TOKEN": r"\b[0-9a-f]{40}\b", "BROKEN": "[unclosed", "STARS": r"\*{3}"}


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace({S.mask('text')}, '\b[0-9a-f]{{40}}\b', '<TOKEN>', 'g'), '\*{{3}}', '<STARS>', 'g') AS masked
  FROM documents""")
def mask_custom(spark, sf):
    return documents(spark, sf).select("doc_id", mask(F.col("text"), _CUSTOM).alias("masked"))


_SIX = ["Subject", "Body", "From", "To", "CC", "BCC"]


@query(S.query(S.RECORDS, "SELECT scan_pos, \"Sender_Email\", " + ", ".join(
    f"""{S.mask(f'"{f}"')} AS "{f}" """ for f in _SIX) + " FROM records"))
def mask_record(spark, sf):
    return messages.mask_records(records(spark, sf)).select("scan_pos", "Sender_Email", *_SIX)


# --- dictionaries ------------------------------------------------------------------------------


@query(S.query(S.LINES, "SELECT source, word, freq FROM parsed WHERE NOT skip AND freq IS NOT NULL"))
def scan_dictionary(spark, sf):
    path = shared_dir(spark, "dictionary")
    sample.dictionary_lines(spark, sf).select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
    lines = readers.read_dictionary_lines(spark, *[f"{path}/source={s}" for s in ("good", "bad", "mixed")])
    return D.parse_lines(lines).select(F.regexp_extract("source", r"/source=(\w+)/", 1).alias("source"), "word", "freq")


@query(S.query(S.LINES, "SELECT source, valid, invalid, message = '' AS is_valid, message FROM verdict"))
def dictionary_validate(spark, sf):
    return D.validate(sample.dictionary_lines(spark, sf))


_MERGED = S.LINES + """,
merged AS (SELECT word, greatest(0, max(freq)) AS freq FROM parsed JOIN verdict USING (source)
  WHERE message = '' AND NOT skip AND freq IS NOT NULL GROUP BY word)"""


@query(S.query(_MERGED, "SELECT word, freq FROM merged"))
def dictionary_merge(spark, sf):
    return D.merge(sample.dictionary_lines(spark, sf))


@query(S.query(_MERGED, "SELECT word, freq FROM merged ORDER BY freq DESC, word"))
def dictionary_by_freq(spark, sf):
    return D.by_frequency(D.merge(sample.dictionary_lines(spark, sf)))


@query(S.query(S.DICTIONARY, "SELECT word, freq FROM dictionary"))
def builtin_dictionary(spark, sf):
    return sample.dictionary(spark, sf)


@query(S.query(_MERGED, """SELECT word, max(freq) AS freq FROM (
  SELECT word, freq FROM merged UNION ALL SELECT word, freq FROM dictionary) GROUP BY word"""))
def domain_dictionaries(spark, sf):
    base = sample.dictionary(spark, sf)
    lines = base.select(F.lit("base").alias("source"), F.col("word").alias("line_no"),
                        F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("line"))
    return D.merge(written(sample.dictionary_lines(spark, sf).unionByName(lines), "all-lines"))


# --- spelling ----------------------------------------------------------------------------------


# The SQL distance works on bytes, so letters beyond ASCII are given capital letters first (words are
# lower-cased). Two edits change a word's set of letters in at most four places: a cheap first test.
_ASCII = "translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_BITS = ("list_sum(list_distinct(list_transform(string_split({x}, ''), "
         "lambda ch: 1::BIGINT << (ascii(ch) % 61))))::BIGINT")


def _corrections(table: str, key: str, text: str) -> str:
    """Best correction by comparing every unknown word with every dictionary word of similar length."""
    return S.DICTIONARY + rf""",
pieces AS (SELECT {key} AS id, unnest(regexp_extract_all(t, '<[A-Z][A-Z0-9_]*>|\p{{L}}+|[^\p{{L}}<]+|<')) AS piece,
    generate_subscripts(regexp_extract_all(t, '<[A-Z][A-Z0-9_]*>|\p{{L}}+|[^\p{{L}}<]+|<'), 1) AS n
  FROM (SELECT *, {text} AS t FROM {table})),
tokens AS (SELECT DISTINCT lower(piece) AS token FROM pieces WHERE regexp_full_match(piece, '\p{{L}}+')),
unknown AS (SELECT token FROM tokens WHERE token NOT IN (SELECT word FROM dictionary)),
letters AS (SELECT token, t, length(t) AS n, {_BITS.format(x='t')} AS bits FROM (SELECT token, {_ASCII.format(x='token')} AS t FROM unknown)),
entries AS (SELECT word, freq, w, length(w) AS m, {_BITS.format(x='w')} AS bits FROM (SELECT word, freq, {_ASCII.format(x='word')} AS w FROM dictionary)),
near AS (SELECT * FROM (SELECT token, word, freq, damerau_levenshtein(t, w) AS distance FROM letters, entries
  WHERE abs(n - m) <= 2 AND bit_count(xor(letters.bits, entries.bits)) <= 4) WHERE distance <= 2),
best AS (SELECT token, word FROM near QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, freq DESC, word) = 1)"""


@query(S.query(_corrections("documents", "doc_id", "text"), "SELECT token, word, distance FROM near"))
def spell_candidates(spark, sf):
    dictionary = written(sample.dictionary(spark, sf), "dictionary")
    tokens = spelling.unknown_words(spelling.vocabulary(documents(spark, sf)), dictionary)
    return spelling.candidates(tokens, dictionary, 2).select("token", "word", F.col("distance").cast("bigint"))


def _rebuilt(out: str, key: str) -> str:
    return f"SELECT id AS {key}, string_agg(coalesce(word, piece), '' ORDER BY n) AS {out} FROM pieces LEFT JOIN best ON lower(piece) = token GROUP BY id"


@query(S.query(_corrections("documents", "doc_id", "text"), _rebuilt("corrected", "doc_id")))
def spell_correct(spark, sf):
    df = spelling.spell_correct(documents(spark, sf), sample.dictionary(spark, sf), "doc_id")
    return df.select("doc_id", "corrected")


def run_together(text):
    """Texts with some words run together and some cut in two, by what letters they have there."""
    glued = F.regexp_replace(text, r"([aeiou]) ([bcdlmt])", "$1$2")
    return F.regexp_replace(glued, r"([a-z]{2}[sn])(e[rn])", "$1 $2")


# Every way to cut a word in two or three is tried, and every pair of neighbours. Doubles are multiplied in the same order.
_COMPOUND = S.query(_corrections("""(SELECT conv_id || '.' || turn AS turn_id, regexp_replace(regexp_replace(text, '([aeiou]) ([bcdlmt])', '\\1\\2', 'g'),
    '([a-z]{2}[sn])(e[rn])', '\\1 \\2', 'g') AS text FROM conversations)""", "turn_id", "coalesce(text, '')") + rf""",
total AS (SELECT CAST(sum(freq) AS DOUBLE) AS n, max(length(word)) AS longest FROM dictionary),
single AS (SELECT token, distance AS edits, CAST(freq AS DOUBLE) AS estimate, word AS replacement FROM near),
cut AS (SELECT token, substr(token, 1, i) AS l, substr(token, i + 1) AS r FROM (
  SELECT token, unnest(range(1, length(token))) AS i FROM unknown)),
two AS (SELECT token, 1 AS edits, x.freq::DOUBLE * y.freq::DOUBLE / n AS estimate, l || ' ' || r AS replacement
  FROM cut JOIN dictionary x ON x.word = l JOIN dictionary y ON y.word = r, total),
three AS (SELECT token, 2 AS edits, (x.freq::DOUBLE * m.freq::DOUBLE / n) * y.freq::DOUBLE / n AS estimate,
    l || ' ' || m.word || ' ' || y.word AS replacement
  FROM cut JOIN dictionary x ON x.word = l, unnest(range(1, length(r))) AS u(k)
  JOIN dictionary m ON m.word = substr(r, 1, k) JOIN dictionary y ON y.word = substr(r, k + 1), total),
halves AS (SELECT DISTINCT r AS part FROM cut JOIN dictionary ON word = l UNION SELECT l FROM cut JOIN dictionary ON word = r),
parts AS (SELECT part, p, length(p) AS k, {_BITS.format(x='p')} AS bits FROM (
  SELECT part, {_ASCII.format(x='part')} AS p FROM halves WHERE part NOT IN (SELECT word FROM dictionary))),
close AS (SELECT part, word, freq FROM parts, entries
  WHERE abs(k - m) <= 1 AND bit_count(xor(parts.bits, entries.bits)) <= 2 AND damerau_levenshtein(p, w) = 1),
rough AS (SELECT token, 2 AS edits, x.freq::DOUBLE * c.freq::DOUBLE / n AS estimate, l || ' ' || c.word AS replacement
  FROM cut JOIN dictionary x ON x.word = l JOIN close c ON c.part = r, total
  UNION ALL SELECT token, 2, c.freq::DOUBLE * y.freq::DOUBLE / n, c.word || ' ' || r
  FROM cut JOIN dictionary y ON y.word = r JOIN close c ON c.part = l, total),
reading AS (SELECT * FROM (FROM single UNION ALL FROM two UNION ALL FROM three UNION ALL FROM rough)
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY edits, estimate DESC, replacement) = 1
  UNION ALL SELECT word, 0, freq::DOUBLE, word FROM dictionary),
spots AS (SELECT a.id, a.n AS i, a.piece || b.piece AS shown, d.word AS joined
  FROM pieces a JOIN pieces s ON s.id = a.id AND s.n = a.n + 1 AND regexp_full_match(s.piece, ' +')
  JOIN pieces b ON b.id = a.id AND b.n = a.n + 2 AND regexp_full_match(b.piece, '\p{{L}}+')
  JOIN dictionary d ON d.word = lower(a.piece) || lower(b.piece)
  LEFT JOIN reading x ON x.token = lower(a.piece) LEFT JOIN reading y ON y.token = lower(b.piece), total
  WHERE regexp_full_match(a.piece, '\p{{L}}+')
  AND (coalesce(x.edits, 3) + coalesce(y.edits, 3) > 1
    OR coalesce(x.edits, 3) + coalesce(y.edits, 3) = 1 AND d.freq > x.estimate * y.estimate / total.n)),
taken AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY i) AS nth FROM (
  SELECT *, i - 2 * row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM spots)),
marks AS (SELECT id, i, joined FROM taken WHERE nth % 2 = 1),
shown AS (SELECT pieces.id, n, CASE WHEN EXISTS (FROM marks m WHERE m.id = pieces.id AND (m.i = n - 1 OR m.i = n - 2)) THEN ''
    ELSE coalesce((SELECT joined FROM marks m WHERE m.id = pieces.id AND m.i = n),
      (SELECT replacement FROM reading WHERE token = lower(piece) AND edits > 0), piece) END AS piece FROM pieces)""",
    "SELECT id AS turn_id, string_agg(piece, '' ORDER BY n) AS corrected FROM shown GROUP BY id")


@query(_COMPOUND)
def spell_compound(spark, sf):
    rows = turns(spark, sf).withColumn("text", run_together(F.col("text")))
    return compound.spell_compound(rows, sample.dictionary(spark, sf), "turn_id").select("turn_id", "corrected")


# --- steps -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.mask('text')} AS processed FROM documents")
def text_stages(spark, sf):
    return textsteps.text_steps(documents(spark, sf), "doc_id").select("doc_id", "processed")


@query(S.query(_corrections("conversations", "conv_id || '.' || turn", S.mask("text")), _rebuilt("processed", "turn_id")))
def text_stages_batch(spark, sf):
    return textsteps.text_steps(turns(spark, sf), "turn_id", dictionary=sample.dictionary(spark, sf)).select("turn_id", "processed")


@query(f"SELECT doc_id, {S.mask('text')} AS masked FROM documents")
def text_memo(spark, sf):
    df = dedup.once_per_text(documents(spark, sf), "text", lambda t: t.withColumn("masked", mask(F.col("text"))), "masked")
    return df.select("doc_id", "masked")


def _careful_rewriter():
    def run(text: str) -> str:
        if "***" in text:
            raise ValueError("cannot rewrite")
        return text.replace("e", "E")
    return run


@query("SELECT doc_id, CASE WHEN contains(text, '***') THEN text ELSE replace(text, 'e', 'E') END AS polished FROM documents")
def polish_hook(spark, sf):
    return documents(spark, sf).select("doc_id", textsteps.rewrite(F.col("text"), _careful_rewriter).alias("polished"))


@query(r"""SELECT doc_id, replace(regexp_replace(text, '\s+', '', 'g'), 'e', 'E') AS joined, TRUE AS fits FROM documents
  WHERE regexp_matches(text, '\S')""")
def chunk_text(spark, sf):
    """Chunks are cut, worked on and joined again; blanks aside nothing is lost, and each fits or is one word."""
    chunks = textsteps.chunk_text(documents(spark, sf)).withColumn("done", F.replace("chunk", F.lit("e"), F.lit("E")))
    joined = textsteps.join_chunks(chunks, "doc_id", "done", "joined")
    fits = (F.length("chunk") <= textsteps.CHUNK) | ~F.rlike("chunk", F.lit(r"\s"))
    checked = chunks.groupBy("doc_id").agg(F.every(fits).alias("fits"))
    return joined.join(checked, "doc_id").select("doc_id", F.regexp_replace("joined", r"\s+", "").alias("joined"), "fits")


def _prompt_rewriter():
    return lambda prompt: "  " if "z" in prompt else prompt.replace("e", "E")


@query("""SELECT turn_id, CASE WHEN contains(text, 'z') THEN text ELSE replace('improve grammar: ' || text, 'e', 'E') END AS polished
  FROM (SELECT conv_id || '.' || turn AS turn_id, text FROM conversations)""")
def prompt_rewrite(spark, sf):
    return turns(spark, sf).select("turn_id", textsteps.rewrite(
        F.col("text"), textsteps.prompted(_prompt_rewriter)).alias("polished"))
