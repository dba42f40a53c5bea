"""Token shards with their index, vector codes and the filter audit against plain versions."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from catalogsmith.llm import filter_audit, packing, quality_rules, queries, textkernel, token_index, vector_codes

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def _plain_index(tokenizer, rows):
    """doc_id, start, n_tokens, crc of every row, by ascending id; rows of one id in any order."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in ordered:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def _key(row):
    return tuple((v is not None, v or 0) for v in row)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 1000, 200_000):
        keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), np.arange(min(n, 5))]).astype(np.int64))[:n]
        hashed = token_index.PerfectHash.build(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
        entries = np.zeros(len(keys), token_index.SLOT)
        entries["offset"] = keys
        file = token_index.IndexFile.from_bytes(token_index.IndexFile.build(keys, entries).to_bytes())
        good, slots = file.find(keys)
        assert good.all() and (slots["offset"] == keys).all()
        strange = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 5000), keys)
        assert file.find(strange)[0].sum() <= 1


def test_perfect_hash_lists_what_levels_leave(monkeypatch):
    monkeypatch.setattr(token_index, "LEVELS", 1)
    keys = np.arange(1000, dtype=np.int64) * 7
    hashed = token_index.PerfectHash.build(keys)
    assert len(hashed.extra) and sorted(hashed.slots(keys).tolist()) == list(range(1000))


def test_token_index(spark, tokenizer, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "x9", "été", "#!", "漢字"]) for _ in range(rng.randrange(40)))) for i in rng.sample(range(-500, 5000), 400)]
    rows += [(7_000, "hot row")] * 300 + [(7_001, f"hot id {i % 3}") for i in range(200)]
    rows += [(None, "no id"), (None, None), (9000, None), (9001, ""), (9002, "long " * 60_000), (2**62, "a"), (-(2**63), "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, key int").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    token_index.write(df, folder, WORDS)
    got = sorted((tuple(r) for r in token_index.lookup(spark, folder, df).collect()), key=_key)
    want = sorted(_plain_index(tokenizer, rows), key=_key)
    alone = lambda rs: [r for r in rs if r[0] is not None and r[0] not in (7_001,)]
    assert alone(got) == alone(want)
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in want)
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    files = token_index.Files(folder)
    assert len(files.shards) > 1
    assert [x.tolist() for x in files.get(9002)] == [tokenizer.encode("long " * 60_000, add_special_tokens=False).ids + [1]]
    assert len(files.get(7_000)) == 300 and len(files.get(7_001)) == 200 and files.get(123_456) == []
    some = spark.createDataFrame([(9000,), (9000,), (5_555_555,), (2**62,)], "doc_id long")
    ids = {r.doc_id: r.ids for r in token_index.lookup(spark, folder, some, with_ids=True).collect()}
    assert ids == {9000: [1], 2**62: tokenizer.encode("a", add_special_tokens=False).ids + [1]}


def test_token_index_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_index.write(df, f"file://{tmp_path}/none", WORDS)
    assert token_index.lookup(spark, f"file://{tmp_path}/none", spark.createDataFrame([(1,), (None,)], "doc_id long")).count() == 0
    assert token_index.Files(f"file://{tmp_path}/none").get(3) == []


def test_token_index_query(spark, data, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_token_index(spark, data).collect())
    assert got == sorted(_plain_index(tokenizer, rows))


def _plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    each = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, label, v + [0] * (parts * each - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * each : (p + 1) * each]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(v, p), []).append(cut(v, p))
            for e, members in groups.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    out, by = [], {}
    for i, label, v in kept:
        codes = [nearest(v, p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        by[label] = by.get(label, 0) + error
        out.append((i, label, "".join(f"{c:02x}" for c in codes), error))
    return sorted(((i, code, error, by[label]) for i, label, code, error in out), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(20, 32))
    rows = [(i, None if i % 7 == 0 else i % 3, (near[i % 20] + rng.normal(size=32) * 0.1).tolist()) for i in range(150)]
    rows += [(200, 1, None), (201, 1, [1.0] * 31 + [None]), (202, 1, [float("nan")] * 32), (203, 1, [float("inf")] * 32), (204, 1, []), (205, 2, [0.5] * 5), (None, 1, [-0.3] * 32)]
    rows += [rows[3]] * 4 + [(3, 2, [0.25] * 32)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(3)
    books = vector_codes.train(df)
    coded = vector_codes.with_label_errors(vector_codes.encode(df, books))
    got = sorted(((r.id, r.code.hex(), r.error, r.label_error) for r in coded.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == _plain_codes(rows)
    back = {r.id: r.vector for r in vector_codes.decode(vector_codes.encode(df, books), books).collect()}
    true = {i: v for i, _, v in rows[:150]}
    assert max(abs(a - b) for i in true if i != 3 for a, b in zip(true[i], back[i])) < 0.8


def test_vector_codes_of_few_or_none(spark):
    schema = "vec_id long, label int, embedding array<double>"
    none = spark.createDataFrame([(1, 1, None)], schema)
    assert vector_codes.train(none) is None and vector_codes.with_label_errors(vector_codes.encode(none, None)).count() == 0
    huge = spark.createDataFrame([(1, 1, [1e300] * 16), (2, 1, [-1e300] * 16), (3, 2, [0.0] * 16)], schema)
    books = vector_codes.train(huge)
    assert books.entries.shape == (16, 3, 1) and vector_codes.encode(huge, books).agg(F.sum("error")).first()[0] == 0


def _plain_audit(rows, labels):
    judged, parts = {}, {}
    for i, quality, toxic in labels:
        good, bad = judged.get(i, (False, False))
        if i is not None:
            judged[i] = good or quality == 1, bad or toxic == 1
    masks = []
    for i, text, part in rows:
        text = text or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        masks.append((part or "", {f for f, v in fails.items() if v}, *judged.get(i, (False, False))))
        parts.setdefault(part or "", []).append(masks[-1])
    out = []
    for part, docs in parts.items():
        found, total = [], {}
        for order in itertools.permutations("ABCDE"):
            for k, name in enumerate(order):
                before = set(order[:k])
                removed = [d for d in docs if name in d[1] and not d[1] & before]
                total[name] = total.get(name, 0) + len(removed)
                found.append([part, "".join(order), k + 1, sum(not d[1] & (before | {name}) for d in docs), len(removed), sum(name in d[1] and bool(d[1] & before) for d in docs), sum(d[1] == {name} for d in docs), sum(d[2] for d in removed), sum(d[3] for d in removed), name])
        out += [(*f[:-1], total[f[-1]]) for f in found]
    return sorted(out)


@pytest.mark.parametrize("lot, fingerprint", [(filter_audit.LOT, None), (2000, None), (3000, lambda raw: len(raw) % 3)])
def test_filter_audit(spark, monkeypatch, lot, fingerprint):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Loud", "LOUD", "#tag", "100%"]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([50, 400, 404])], k=rng.choice([0, 5, 99, 100, 150]))) for _ in range(40)] + [None, "", "a\x1cb\x85c d" * 60, "ABé\U0001f600" * 300]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(500 + i % 40, "one hot text", "en") for i in range(120)] + [(None, "one hot text", "de"), (None, None, None)] + [(3, rows[3][1], "en")] * 5
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 600, 3)] + [(3, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int").repartition(3)
    judged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "LOT", lot)
    masked = filter_audit.masks(df, **({"fingerprint": fingerprint} if fingerprint else {}))
    found = filter_audit.vectors(masked, judged).flatMap(lambda kv: [(kv[0], *row) for row in filter_audit.steps(kv[1])]).collect()
    assert sorted(found) == _plain_audit(rows, labels)
    assert filter_audit.audit(df.where("false"), judged).count() == 0


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_polynomials_confuse(spark, tokenizer):
    one = _thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    slab = textkernel.Slab([one, other, one])
    found = slab.hash(slab.bounds[:-1], slab.bounds[1:])
    assert found[0] == found[2] != found[1]
    file = open(WORDS, "rb").read()
    got = packing.WordEncoder(file).encode([f"{one} {other}", other])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (f"{one} {other}", other)]
    df = spark.createDataFrame([(1, f"{one}\n{other}"), (2, f"{one}\n{one}")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.judge(df).collect()} == {1: 0, 2: 1}
