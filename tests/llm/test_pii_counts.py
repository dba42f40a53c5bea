"""What decides disclosure is counted exactly."""

import numpy as np

from catalogsmith.llm import pii, sketch


def term_of(word):
    return int(pii._terms(pii.Slab([word]))[3][0])


def test_frequencies_do_not_depend_on_other_terms(spark):
    """With more terms than a sketch of 2 x 2**20 counters can tell apart, rare revealing terms are still found."""
    rng = np.random.default_rng(5)
    telling = [f"Report {i}: Zanzibarius wrote to zan@corp.example about something" for i in range(3)]
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words = letters[rng.integers(0, 26, (1200, 4000, 8))]
    words[:, :, 7] = ord(" ")
    others = [w.tobytes().decode() for w in words]
    assert 4000 * len(others) > 4 * (1 << sketch.BITS)
    df = spark.createDataFrame([(t,) for t in [*telling, *others]], "text string").repartition(8)
    found = {r.term: r.removed for r in pii.revealing_terms(df).collect()}
    assert found.get(term_of("Zanzibarius")) is True


def test_copies_count_once(spark, monkeypatch):
    telling = [f"Report {i}: Zanzibarius wrote to zan@corp.example about something" for i in range(3)]
    others = [f"The matter of number {'xyz'[i % 3] * (i + 1)} that nobody knew" for i in range(60)]
    one, many = (spark.createDataFrame([(t,) for t in [*telling * n, *others]], "text string").repartition(4) for n in (1, 25))
    found = []
    for most in (1_000_000, -1):  # broadcast, and joined
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        found += [{r.term: r.removed for r in pii.revealing_terms(df).collect()} for df in (one, many)]
    assert found[0] == found[1] == found[2] == found[3] and found[0][term_of("Zanzibarius")] is True
