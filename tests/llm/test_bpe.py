import os
import random

import pytest
from pyspark.sql import functions as F

from veriloom.llm import bpe

FOLDER = "/opt/tokenizers"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabularies here")
PATH = f"{FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(open(PATH, "rb").read()))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_ids(encoder, reference):
    r = random.Random(2)
    texts = ["Hello world", " <|endoftext|> x", "赔付支出累计为1,234.5亿元。", "a" * 3000, " " * 500, "\n\n \t x  ", "é́😀‍👩", "it's we'LL", "不" * 2000]
    texts += ["".join(r.choice("abe  ть不保1,.\n'sé😀") for _ in range(r.randrange(1, 60))) for _ in range(800)]
    for t in texts:
        assert encoder.encode(t) == reference(t), t[:60]


def test_null_and_empty(encoder):
    assert encoder.encode(None) == [] and encoder.encode("") == []


def test_other_vocabulary_of_the_kind():
    import tiktoken

    data = open(f"{FOLDER}/byte_bpe_multi_50k.tiktoken", "rb").read()
    tokens = bpe.read_ranks(data)
    want = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    mine = bpe.Encoder(tokens)
    for t in ["Regulation Nr. 5, Straße", "资本充足率不得低于", "Вельдория и Καλδρία"]:
        assert mine.encode(t) == want.encode_ordinary(t)


def test_rows(spark, reference):
    rows = [(1, "资本 capital"), (2, None), (3, ""), (4, "x" * 200_000), (1, "资本 capital")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df, "doc_id", "text", PATH).collect())
    assert got == sorted((d, reference(t) if t else []) for d, t in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
    n = {(r["doc_id"], r["n_tokens"]) for r in bpe.sizes(df, "text", PATH).collect()}
    assert n == {(d, len(reference(t)) if t else 0) for d, t in rows}
