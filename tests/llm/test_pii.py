import os
import sys
from collections import Counter

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from held_out_pii import held_out  # noqa: E402

from parleyspark.llm import pii  # noqa: E402
from parleyspark.llm.crf import viterbi_stretches  # noqa: E402
from parleyspark.llm.pii_table import TYPES, labelled  # noqa: E402


def test_held_out_accuracy():
    table = labelled(1200, seed=77)
    found = pii.find([t for t, _ in table])
    hit, want, got = Counter(), Counter(), Counter()
    for (_, spans), f in zip(table, found):
        truth, ours = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in f}
        for counter, xs in ((hit, truth & ours), (want, truth), (got, ours)):
            counter.update(k for _, k in xs)
    for k in TYPES:
        assert hit[k] / want[k] > 0.95 and hit[k] / got[k] > 0.95, k


def measured(texts):
    """Recall and precision of each type."""
    hit, want, got = Counter(), Counter(), Counter()
    for (_, truth), f in zip(texts, pii.find([t for t, _ in texts])):
        ours = {(a, k) for a, _, k in f}
        for counter, xs in ((hit, truth & ours), (want, truth), (got, ours)):
            counter.update(k for _, k in xs)
    return {k: (hit[k] / want[k], hit[k] / got[k]) for k in TYPES}


def test_texts_of_elsewhere():
    got = measured(held_out())
    assert min(min(x) for x in got.values()) >= 0.85 and sum(sum(x) for x in got.values()) / (2 * len(got)) >= 0.93, got


def test_long_local_parts():
    local = "x" * 300 + ".y"
    assert pii.find([f"Contact: {local}@mail.brook.example."]) == [[(9, 9 + len(local) + 19, "email")]]


def test_examples():
    cases = [
        ("Contact: jost.thorpe+x@mail.brook.example. Order PO-62570-74 is 83.31 EUR.", {(9, "email")}), ("My number is +44 (0)7700 900 672.", {(13, "phone")}), ("Call me on (555) 010-0199 after six.", {(11, "phone")}), ("I talked to Dr. Clara Velquist about it.", {(16, "person_name")}),
        ("We live at 1309 West Kettle Drive please.", {(11, "street_address")}), ("Lieferung bitte an Mühlweg 75b, 00485 Altenau", {(19, "street_address")}), ("The job ran as deploy@build-06 at 10.95.254.187:9105.", set()), ("Use `user@host` as a literal, and 911-945 as the id range.", set()),
        ("See build 20250995.9, lot 2026-09-7428.", set()), ("ref 1b808607-e921-4dd5-85c9-6b1eea5fb883", set()), ("Ask Emil about it.", set()), ("", set()),
    ]
    for (text, want), spans in zip(cases, pii.find([t for t, _ in cases])):
        assert {(a, k) for a, _, k in spans} == want, text


def test_stretches_hold_the_best_path():
    import numpy as np

    crf = pii.tagger()
    texts = [t for t, _ in labelled(150, seed=5)]
    _, sig = crf.encode(texts)
    E = crf.emissions(sig)
    every = viterbi_stretches(E, crf.T, np.ones(len(E), bool))
    assert (crf.tag(texts)[2] == every).all()


def test_tables(spark):
    text = "Please ask Marta Quinberg about it. \0 Contact: marta.q@example.org ."
    rows = [("a", text, 1), ("a", text, 1), ("b", None, 1), ("c", "", 1), (None, text, 1), ("d", "word 12 " * 40_000 + text, 1)]
    df = spark.createDataFrame(rows, "uuid string, text string, start_char int")
    got = {(r["row_key"], r["pii_type"], r["start_char"]) for r in pii.find_pii(df, "uuid", "text", "messages").collect()}
    assert got == {(k, t, n + off) for k, off in (("a", 0), ("d", 320_000)) for t, n in (("person_name", 11), ("email", 47))}
    out = [r[0] for r in df.select(pii.redacted(F.col("text"))).collect()]
    assert out[0] == "Please ask [NAME] about it. \0 Contact: [EMAIL] ." and out[2] is None and out[3] == "" and out[5] == "word 12 " * 40_000 + out[0]
    assert pii.find_pii(df.where("false"), "uuid", "text", "messages").count() == 0
