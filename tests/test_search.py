"""Against the full-text engine of the standard library."""

import math
import random
import sqlite3

import pytest

from parleyspark.functions.porter import stem
from parleyspark.operators.search import Index, Query, SearchError, score, tokens

WORDS = "run running runs runner café cafe the foo_bar connection connected relational conditional hopping agreed happy sky node nodes deploy deployed rate ties dies v2 42".split()
QUERIES = ["run", "running OR cafe", "the NOT run", "run happy", '"the sky"', "node*", "^run", "NEAR(run happy, 3)", "NEAR(run sky happy)", "foo_bar", "(run OR sky) AND node", "run NOT sky happy", "run NOT sky AND happy", "a + b", '"sky happy" OR ties', "dies", "v2 42", "^the OR sky*", '"happy node"*']
BAD = ["run OR", "(run", "it's", "run,sky", "c++", "NOT x", "", "e.g.", "running-shoes", "AND", "run)"]


def test_hits_and_ranks(spark):
    rnd = random.Random(1)
    docs = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 18))) for _ in range(60)] + [None]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(docs)))
    split = [tokens(d) for d in docs]
    for text in QUERIES:
        theirs = dict(db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (text,)))
        q = Query(text)
        counts = [q.counts(w) for w in split]
        assert {i for i, (w, c) in enumerate(zip(split, counts)) if q.matches(w, c)} == set(theirs), text
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "id string, t string")
    for text in ("run happy", "running OR cafe", "run NOT sky happy", "NEAR(run happy, 3)"):
        theirs = dict(db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (text,)))
        ours = {int(r["id"]): r["rank"] for r in score(df, text, "id", "t").collect()}
        assert ours.keys() == theirs.keys() and all(math.isclose(ours[k], theirs[k], abs_tol=1e-9) for k in ours)


def test_index_gives_what_one_pass_gives(spark):
    rnd = random.Random(4)
    docs = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 18))) for _ in range(60)] + [None, "  "]
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "id string, t string")
    index = Index(df, "id", "t")
    for text in QUERIES:
        ours, theirs = ({r["id"]: r["rank"] for r in x.collect()} for x in (index.score(text), score(df, text, "id", "t")))
        assert ours.keys() == theirs.keys() and all(math.isclose(ours[k], theirs[k], abs_tol=1e-9) for k in ours), text


@pytest.mark.parametrize("text", BAD)
def test_syntax_errors(text):
    with pytest.raises(SearchError):
        Query(text)


def test_stems():
    assert [stem(w) for w in "caresses ponies cats feed agreed plastered motoring happy relational conditional vietnamization probate rate cease controll roll sky".split()] == "caress poni cat feed agre plaster motor happi relat condit vietnam probat rate ceas control roll sky".split()


def test_columns_in_queries():
    assert Query("text: run AND node*").units == Query("run AND node*").units
    with pytest.raises(SearchError, match="no such column"):
        Query("sender: human")
