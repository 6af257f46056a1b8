"""The text operators do the whole job, beyond the sizes of the other tests."""

import base64
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import jaccard_join, langid
from siltstone.llm.common import crc_mod

SF = "/root/testdata/sf0.1"


def test_chunks_hold_no_more_nodes_than_there_are_numbers(monkeypatch):
    assert jaccard_join.NODES <= 1 << 20
    batches = [pa.RecordBatch.from_pydict({"text": [f"w{j}" for j in range(i, i + 50)]}) for i in range(0, 250, 50)]
    monkeypatch.setattr(jaccard_join, "NODES", 100)
    assert [len(c) for c in jaccard_join._chunks(batches, 5)] == [100, 100, 50]


FOREIGN = [
    "Il gatto dorme sul divano mentre fuori piove e la nonna prepara la cena per tutta la famiglia",
    "Kissa nukkuu sohvalla kun ulkona sataa ja isoäiti valmistaa illallista koko perheelle",
    "A macska a kanapén alszik miközben kint esik az eső és a nagymama vacsorát készít az egész családnak",
    "Kot śpi na kanapie podczas gdy na dworze pada deszcz a babcia gotuje kolację dla całej rodziny",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_langid_keeps_its_languages_and_rejects_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    held = langid.identify(docs.filter(crc_mod("doc_id", 4) == 2).filter("lang IS NOT NULL"), model)
    n, rejected = held.agg(F.count(F.lit(1)), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 2000 and rejected / n < 0.005
    rng = random.Random(1)
    word = [lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))), lambda: base64.b64encode(rng.randbytes(6)).decode()]
    noise = [" ".join(w() for _ in range(k)) for w in word for k in (20, 50, 200, 400) for _ in range(40)]
    far = langid.identify(spark.createDataFrame([(t,) for t in noise + FOREIGN], "text string"), model)
    assert far.filter("NOT rejected").count() == 0
