import random
import tracemalloc
import zlib

import numpy as np
import pytest

from postmill.llm import cnn, queries


def corpus(n, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("etaoinsrhd") for _ in range(r.randint(2, 7))) for _ in range(r.randint(30, 250))]
        good = i % 3 > 0
        if not good:
            kind = i % 4
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + " |" for w in words] if kind == 1 else \
                [w for w in words[:25] for _ in range(9)]
        rows.append((i, " ".join(words), int(good)))
    return rows


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_gradients():
    r = np.random.default_rng(0)
    raws = [bytes(r.integers(97, 110, size=n).tolist()) for n in (5, 300, 900, 0)]
    y = np.array([0, 1, 1, 0], np.float32)
    net, packed = cnn.Network(1), cnn.pack(raws)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(packed, y)
    for k, v in net.p.items():
        flat, slope = v.reshape(-1), np.asarray(g[k]).reshape(-1)
        at = int(np.abs(slope).argmax())
        flat[at] += 1e-5
        up = net.gradients(packed, y)[0]
        flat[at] -= 2e-5
        down = net.gradients(packed, y)[0]
        flat[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(slope[at], rel=1e-2, abs=1e-6)


def test_every_part_of_a_text_counts_and_texts_do_not_touch():
    net = cnn.Network(3)
    r = random.Random(0)
    good = ("".join(r.choice("etaoin ") for _ in range(20000))).encode()
    for at in (0, 9000, len(good) - 40):
        spoiled = good[:at] + b"#" * 40 + good[at + 40:]
        assert net.score([spoiled])[0] != net.score([good])[0]
    batch = [good[:700], b"", good[:123], good]
    alone = [net.score([x])[0] for x in batch]
    assert net.score(batch) == pytest.approx(alone, rel=1e-5)


def test_distances_by_definition():
    raw = b"abcdefgh....abcdefgh" + b"x" * 40 + b"abcdefghQ"
    packed = cnn.pack([raw, raw])
    classes = (packed.codes // 256)[:len(raw)]
    for i in range(len(raw) - 7):
        last = max((j for j in range(i) if raw[j:j + 8] == raw[i:i + 8]), default=None)
        want = 0 if last is None else next((k + 1 for k, d in enumerate(cnn.NEAR) if i - last <= d), 0)
        assert classes[i] == want
    assert (packed.codes[:128] == packed.codes[128:]).all()


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in cnn.scored(docs, labels, cnn.Sample(least_steps=200)).collect()}
    assert all(r.held_out == out(i) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in rows if out(i)]) > 0.95


def test_query_covers_all_rows(spark, sf_dir):
    got = queries.op7_quality_cnn(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    quick = cnn.Sample(least_steps=5, epochs=1)
    got = cnn.scored(odd_docs, labels, quick).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r.doc_id or 0 for r in odd_docs.collect())
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert {r.score for r in cnn.scored(odd_docs, no_labels, quick).collect()} == {0.5}
    assert cnn.scored(no_docs, labels, quick).collect() == []


def plain_logit(net, raw):
    """The forward pass by its definition, a filter place at a time."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    blocks = -(-(len(raw) + 8) // 128)
    data = raw + bytes(blocks * 128 - len(raw))
    vectors = []
    for i, byte in enumerate(data):
        gram = data[i:i + 8]
        last = data.rfind(gram, 0, i + 7) if byte and len(gram) == 8 else -1
        near = next((k + 1 for k, d in enumerate(cnn.NEAR) if i - last <= d), 0) if last >= 0 else 0
        vectors.append(p["table"][byte + 256 * near])
    spots = [np.concatenate(vectors[i:i + 8]) for i in range(0, len(data), 8)]
    conv = [np.maximum(s @ p["a"] + spots[min(k + 1, len(spots) - 1)] @ p["b"] + p["c"], 0) for k, s in enumerate(spots)]
    top = [np.max(conv[k:k + 16], axis=0) for k in range(0, len(conv), 16)]
    mean = [np.mean(conv[k:k + 16], axis=0) for k in range(0, len(conv), 16)]
    hidden = []
    for k in range(blocks):
        n = min(k + 1, blocks - 1)
        chunk = np.concatenate([np.maximum(top[k], top[n]), (mean[k] + mean[n]) / 2])
        hidden.append(np.maximum(chunk @ p["v"] + p["w"], 0))
    return float(np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)]) @ p["u"] + p["z"][0])


@pytest.mark.parametrize("size", [0, 1, 7, 120, 121, 128, 500, 1500])
def test_forward_equals_plain_loops(size):
    r = random.Random(size)
    raw = "".join(r.choice("abc") for _ in range(size)).encode()
    net = cnn.Network(5)
    want = plain_logit(net, raw)
    assert net.forward(cnn.pack([raw]))["logit"][0] == pytest.approx(want, rel=1e-4, abs=1e-5)
    assert net.long_logit(raw) == pytest.approx(want, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("run", [1, 2, 3, 7, 1000])
def test_runs_of_blocks_give_what_the_whole_gives(monkeypatch, run):
    r = random.Random(1)
    words = ["".join(r.choice("etaoin") for _ in range(r.randint(2, 7))) for _ in range(60)]
    raw = " ".join(r.choice(words) for _ in range(3000)).encode()
    net = cnn.Network(5)
    whole = net.forward(cnn.pack([raw]))["logit"][0]
    monkeypatch.setattr(cnn, "RUN_BLOCKS", run)
    assert net.long_logit(raw) == pytest.approx(whole, rel=1e-4, abs=1e-5)
    assert net.score([b"short", raw, b""])[1] == pytest.approx(1 / (1 + np.exp(-whole)), rel=1e-4)


def test_a_very_long_text_takes_bounded_memory():
    raw = random.Random(3).randbytes(1 << 20) * 64
    net = cnn.Network(2)
    tracemalloc.start()
    score = net.score([raw])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1 and most < 100 << 20
