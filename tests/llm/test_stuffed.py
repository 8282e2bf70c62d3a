import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import stuffed as S

NOUNS = "capital reserve audit branch office filing report annex ratio premium balance notice scope table note firm panel plan desk quarter".split()
TERMS = ["cheap cover", "fast loan", "pet cover", "low rate", "free quote", "no fee card", "best savings", "debt relief"]


def corpus(seed=6):
    r = random.Random(seed)
    prose = ["The {0} {1} shall be kept within {2} working days of this {3}.", "Compared with the prior {0}, the revision changes how the {1} is measured and drops one {2}.", "If the {0} stays below {1} percent for months, the {2} explains why.", "Note {0} explains a break in the {1} from then on."]
    docs = {}
    for i in range(160):
        docs[i] = " ".join(r.choice(prose).format(*(r.choice(NOUNS) for _ in range(4))) for _ in range(r.randrange(3, 20)))
    spam = set()
    for i in range(160, 180):
        few = r.sample(TERMS, 3)
        kind = i % 3
        docs[i] = " | ".join(r.choice(few) for _ in range(60)) if kind == 0 else "\n".join(f"{r.choice(TERMS)} https://go.site{r.randrange(99)}.test/p/{r.randrange(9999)}" for _ in range(20)) if kind == 1 else " ".join(f"Looking for {few[0]}? Our {few[0]} is the {few[0]} for {few[0]}." for _ in range(15))
        spam.add(i)
    docs[181] = "\n".join(f"Chapter {k} {r.choice(NOUNS)} {r.choice(NOUNS)} …… {k * 3}" for k in range(12))
    docs[182] = docs[3] + "\nTags: cheap cover, fast loan"
    docs[183], docs[184], docs[185], docs[186] = None, "", "word", "  \n "
    return docs, spam


def test_tokens_and_terms():
    codes, lengths = S.tokenise("Pet_coverKelpen 12.5 低息贷款！a")
    assert len(codes) == 10 and lengths.sum() == len("Pet_coverKelpen 12.5 低息贷款！a")
    t = S.terms(codes)
    assert t[3] == 0 and t[4] == 0 and len(set(t[5:9].tolist())) == 3 and t[0] == codes[0]
    assert len(S.tokenise(None)[0]) == 0 and len(S.terms(S.tokenise("")[0])) == 0


def test_counts_equal_brute_force(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    got = {(r["kind"], r["code"]): (r["c"], r["d"]) for r in S.corpus_counts(df).collect()}
    words, pairs, held = {}, {}, {}
    for t in docs.values():
        c = S.tokenise(t)[0]
        for x in c.tolist():
            words[x] = words.get(x, 0) + 1
        p = S._mix(c[:-1], c[1:]).tolist()
        for x in p:
            pairs[x] = pairs.get(x, 0) + 1
        for x in set(p):
            held[x] = held.get(x, 0) + 1
    assert {k: v[0] for (kind, k), v in got.items() if kind == 0} == words
    assert {k: v for (kind, k), v in got.items() if kind == 1} == {k: (n, held[k]) for k, n in pairs.items()}


def test_flags_spam_only_and_joins_agree(spark):
    docs, spam = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string").withColumns({"key": F.lit(1), "part": F.lit("clash")})
    b = S.Bounds()
    small = {r["doc_id"]: r for r in S.stuffed(df, "doc_id", "text", b).collect()}
    assert set(small) == set(docs)
    assert {d for d, r in small.items() if r["flagged"]} == spam
    # A vocabulary too large to send goes by joins, with the same result.
    large = {r["doc_id"]: r["part"] for r in S.stuffed(df, "doc_id", "text", replace(b, most=5)).collect()}
    assert all(large[d] == pytest.approx(r["part"]) for d, r in small.items())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert S.stuffed(df, "doc_id", "text").count() == 0
    assert S.stuffed(spark.createDataFrame([(1, None)], "doc_id int, text string"), "doc_id", "text").first()["part"] == 0.0


def test_part_is_a_part_of_the_characters():
    found, share = np.array([5, 6, 0, 7, 8], np.int64), np.array([1.0, 1.0, 0.0, 0.0, 0.0])
    assert S.stuffed_part(found, share, np.array([4, 4, 2, 5, 5]), replace(S.Bounds(), window=1)) == pytest.approx(8 / 20)
