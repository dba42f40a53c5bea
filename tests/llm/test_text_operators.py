"""Quality rules, packing, PII, byte BPE, language ID, toxicity and quality classifier against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogsmith.llm import byte_bpe, language_id, packing, pii, quality_classifier, quality_rules, queries, toxicity
from catalogsmith.llm.textkernel import Slab

ODD = [None, "", " ", "a", "the same line\nthe same line\n\nthe same line", "w " * 400, "x" * 20_000, "é ñ ß 你好 😀", "tab\tand\x1cseparator <|endoftext|> don't", "token " * 5000]
SCHEMA = "doc_id long, text string, lang string, n_words string, kept int, clean string"


def odd(spark, texts=ODD):
    """Null and clashing columns, ties and repeated rows."""
    rows = [(i, t, None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "null id text here", "en", None, None, None)], SCHEMA)


def plain_base(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality_rules(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    both = odd(spark).select((F.col("doc_id") - 1000).alias("doc_id"), "text", "lang").where("doc_id is not null").unionByName(docs)
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in quality_rules.judge(both).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_rules.judge(both.where("false")).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    tokenizer = Tokenizer.from_file(path)
    rows = packing.Packer(spark, path).pack(odd(spark), with_ids=True).collect()
    pieces = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(ODD[:-1]):
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and w[0][0] == 0 and sum(w[-1]) <= 2048
    for mine in pieces.values():
        for r in mine:
            assert r.doc_tokens >= r.start + r.length
    for i in range(len(ODD) - 1):
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and {r.doc_tokens for r in mine} == {sum(r.length for r in mine)}
    parts = {r.sequence_id >> 33 for r in rows}
    assert len(windows) <= sum(r.length for r in rows) / 2048 + 2 * len(parts)  # little padding: a part leaves about one window open
    assert packing.Packer(spark, path).pack(odd(spark).where("false")).count() == 0


def test_best_fit_takes_the_tightest_window():
    at, offset, count = packing.best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert count == 2 and at == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]


def test_byte_bpe(spark):
    import tiktoken

    path = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    tokenizer = byte_bpe.Tokenizer(spark, path, queries.PATTERN)
    encoded = tokenizer.encode(odd(spark).where("doc_id is not null"))
    for r in encoded.collect():
        assert r.ids == own.encode_ordinary(ODD[r.doc_id] or "")
    for r in tokenizer.decode(encoded).collect():
        assert bytes(r.bytes).decode() == (ODD[r.doc_id] or "")
    for r in tokenizer.digests(odd(spark).where("doc_id is not null")).collect():
        ids = own.encode_ordinary(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


PII = ["a@b.c d@e", "mail x.y+z@mail.example.org, a@b.c_d@x.yy", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-99-88 +12 3", "@@ a@ @b.c"]


@pytest.mark.parametrize("text", PII)
def test_pii_patterns(text):
    digits = lambda s: re.sub(r"\D", "", s)
    plain = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    ]
    assert pii.base_spans(text) == plain


def test_revealing_terms(spark, monkeypatch):
    telling = [f"Report {i}{'abc'[i % 3] * i}: Zanzibarius wrote to zan@corp.example about the matter" for i in range(5)]
    plain = [f"The matter of number {'xyz'[i % 3] * (i + 1)} was about a report that nobody wrote" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*telling, *plain, "Zanzibarius again", None, ""])], "doc_id long, text string")
    for most in (1_000_000, -1):  # broadcast, and joined
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        found = {r.doc_id: r for r in pii.sanitise(df, limits=pii.Disclosure(bits=3.0)).collect()}
        assert len(found) == 68 and found[0].n_email == 1 and "term:" in found[0].spans and "Zanzibarius" not in found[0].clean and "[EMAIL]" in found[0].clean
        assert found[65].clean == "[TERM] again" and found[10].clean == plain[5] and found[66].spans == found[67].spans == "" and found[0].row.text == telling[0]
    assert pii.sanitise(df.where("false")).count() == 0
    assert pii.sanitise(odd(spark)).count() == len(ODD) + 2


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.where(~held))
    rows = language_id.identify(docs.where(held), model, keep=True).select("lang_pred", "row.lang").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd(spark), model).collect()}
    assert got[0] == got[1] == got[2] == "und" and len(got) == len(ODD) + 1
    assert language_id.identify(odd(spark), language_id.train(docs.where("false"))).where("lang_pred != 'und'").count() == 0
    words = dict(language_id.word_languages(model, "the thing of that and elle pour les dans une"))
    assert words["the"] == "en" and words["pour"] == "fr"


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    scores, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    got, expected = language_id.forward_backward(scores, np.array([0, 4]), move, pairs=True)
    total, marginal, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        weight = np.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for i, k in enumerate(path):
            marginal[i, k] += weight
        for a, b in zip(path, path[1:]):
            pairs[a, b] += weight
    assert np.allclose(got, marginal / total) and np.allclose(expected, pairs / total)


def test_blocks_of_a_chain_change_nothing():
    import numpy as np

    rng = np.random.default_rng(2)
    bounds = np.array([0, 1, 8, 30, 32, 95, 100])
    scores, move = 3 * rng.normal(size=(100, 4)), 2 * rng.normal(size=(4, 4))
    whole, _ = language_id.forward_backward(scores, bounds, move, block=1000)
    for block in (1, 2, 7, 31):
        assert np.allclose(language_id.forward_backward(scores, bounds, move, block=block)[0], whole, atol=1e-12)
    slab = language_id.Slab(["a b " * 400 + "\nc", "d"], apart=True)
    assert language_id.chains_of(slab, language_id.Words(slab)).tolist() == [0, 800, 801, 802]


def test_toxicity_tolerates_gaps(spark):
    filler = ["the report was long and clear", "a table of numbers for the city", "people walked home in the rain", "music and bread in the morning"]
    docs = [f"{filler[i % 4]} number {i} {'moron' if i % 3 == 0 and i % 2 else 'idiot' if i % 3 == 0 else 'river'} {filler[(i + 1) % 4]}" for i in range(150)]
    model = toxicity.fit(docs, [int(i % 3 == 0) for i in range(150)])
    test = ["you i.d.i.o.t there", "you idixot there", "an 1d1ot", "the river was long", None, "", "x" * 5000]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(got[:3]) > max(got[3:]) and all(0 <= s <= 1 for s in got)
    assert toxicity.fit(["a b"], [0]).constant == 0.0 and toxicity.fit([], []).constant == 0.0
    assert toxicity.score(odd(spark), model).count() == len(ODD) + 2


def test_string_kernel_table_equals_the_kernel():
    import numpy as np

    words = [bytes(c - 96 for c in w.encode()) for w in ("idiot", "idixot", "table")]
    bag = toxicity.Bag(words)
    of = np.unique(bag.index)
    phi = bag.dense(of)
    table = np.zeros(1 << 20, np.float32)
    table[of] = phi[0]
    slab = Slab(["idiot idixot table"], apart=True)
    stream, first, sizes, _ = toxicity.read_words(slab)
    assert np.allclose(toxicity.word_scores(table, stream, first, sizes), phi @ phi[0], atol=1e-5)


def test_quality_classifier_on_held_out_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_classifier.train(docs, labels.where(~held))
    rows = quality_classifier.classify(docs, model).join(labels.where(held), "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert good and bad
    assert sum(r.quality_kept for r in good) >= 0.95 * len(good) and sum(not r.quality_kept for r in bad) >= 0.6 * len(bad)


def test_quality_classifier_on_odd_tables(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    more = odd(spark).toDF("doc_id", "text", "source", "p_doc", "quality_kept", "a b-`c")
    got = quality_classifier.classify(more, model)
    assert got.columns == ["doc_id", "text", "source", "a b-`c", "p_doc", "p_site", "quality_score", "quality_kept"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and not any(r.quality_kept for r in rows if not (r.text or "").strip())
    assert quality_classifier.judged(more, model).select("row.*").columns == more.columns
    assert quality_classifier.classify(docs.where("false"), model).count() == 0


def test_posteriors_by_hand(spark):
    """Grouped sums, strengths and shrinkage recomputed in plain Python."""
    import random

    rng = random.Random(4)
    rows = [(f"h{h}.org/p{h % 3}/x", min(max(rng.gauss(0.2 + 0.1 * (h % 7), 0.1), 0.0), 1.0)) for h in range(12) for _ in range(2 + 9 * h)]
    rows += [(f"h{h}.org/q", 0.5) for h in range(5)]
    site, prior = quality_classifier.site_posteriors(spark.createDataFrame(rows, "url string, p double"), *quality_classifier.site_keys(F.col("url")))
    got = {r.path_key: r.site for r in site.collect()}

    def sums(key):
        out = {}
        for url, p in rows:
            n, s, q = out.get(key(url), (0, 0.0, 0.0))
            out[key(url)] = (n + 1, s + p, q + p * p)
        return out

    def strength(groups):
        total, g = sum(n for n, _, _ in groups), len(groups)
        mean = sum(s for _, s, _ in groups) / total
        within = sum(q - s * s / n for n, s, q in groups) / max(total - g, 1)
        between = sum(s * s / n for n, s, _ in groups) / total - mean * mean
        return min(max(within / max(between - within * g / total, 1e-4), 5), 1000)

    hosts, paths = sums(lambda u: u.split("/")[0]), sums(lambda u: "/".join(u.split("/")[:2]))
    plain_prior = sum(p for _, p in rows) / len(rows)
    k, below = strength(list(hosts.values())), strength(list(paths.values()))
    assert abs(prior - plain_prior) < 1e-9
    for path, (n, s, _) in paths.items():
        hn, hs, _ = hosts[path.split("/")[0]]
        host = (hs + k * plain_prior) / (hn + k)
        assert abs(got[path] - (s + below * host) / (n + below)) < 1e-9


def test_string_kernel_by_enumeration():
    """Word scores against the sum over all pairs of subsequences, straight from the definition."""
    import itertools

    import numpy as np

    def weights(word):
        padded = [0, 0, *(c - 96 for c in word.encode()), 0, 0]
        out = {}
        for places in itertools.combinations(range(len(padded)), 4):
            gaps = [b - a for a, b in zip(places, places[1:])]
            letters = tuple(padded[i] for i in places)
            if max(gaps) <= 2 and sum(gaps) <= 5 and letters[1] and letters[2]:
                out[letters] = out.get(letters, 0) + toxicity.DECAY ** (sum(gaps) - 3)
        return {k: v / toxicity.length_norm(np.array(len(word))) for k, v in out.items()}

    words = ["idiot", "idixot", "table", "moron"]
    bag = toxicity.Bag([bytes(c - 96 for c in w.encode()) for w in words])
    phi = bag.dense(np.unique(bag.index))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = weights(a), weights(b)
            assert abs(sum(v * y.get(k, 0) for k, v in x.items()) - float(phi[i] @ phi[j])) < 1e-4


def test_toxicity_on_held_out_labels(spark):
    """On the 1 % tables: 33 toxic rows to learn from, so recall is low there; what it calls toxic is."""
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in queries.op8_toxicity(spark, data).collect() if r.held_out and labels.get(r.doc_id) is not None]
    said = [labels[r.doc_id] for r in rows if r.predicted]
    assert all(0 <= r.score <= 1 for r in rows) and said and sum(said) >= 0.9 * len(said) and sum(said) >= 0.3 * sum(labels[r.doc_id] for r in rows)


def test_letters_beyond_the_first_plane(spark, data):
    model = language_id.train(spark.read.parquet(f"{data}/documents.parquet"))
    df = spark.createDataFrame([(1, "😀😀 🎉", "x"), (2, "𝒜𝒷𝒸 the of and to", "x")], "doc_id long, text string, `a b-c` string")
    got = {r.doc_id: r for r in language_id.identify(df, model, keep=True).collect()}
    assert got[1].lang_pred == "und" and got[1].score == 0 and got[2].lang_pred != "und" and got[1].row["a b-c"] == "x"
    assert [r.n_term for r in pii.sanitise(df).collect()] == [0, 0]
    starts, ends, _, _ = pii._terms(Slab(["((((((word))))))"]))
    assert (starts.tolist(), ends.tolist()) == ([6], [10])


def test_sparse_sites_shrink(spark):
    df = spark.createDataFrame([("http://a.org/x/1", 0.0)] * 2 + [("https://b.org/y", 0.9)] * 300 + [("c.org", 0.1)] * 300, "url string, p double")
    site, prior = quality_classifier.site_posteriors(df, *quality_classifier.site_keys(F.col("url")))
    got = {r.path_key: r.site for r in site.collect()}
    assert abs(got["c.org"] - 0.1) < 0.05 and abs(got["b.org/y"] - 0.9) < 0.05 and got["a.org/x"] > 0.1 and 0.4 < prior < 0.6
