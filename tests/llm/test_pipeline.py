"""The pipeline against a brute-force version, and its stages on odd and on no documents."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import langid_brute
import public_tokenizers
import pytest

from siltstone.llm import byte_bpe, langid

SF = "/root/testdata/sf0.001"


def brute_mix(docs):
    """(doc_id, source, words) rows to numbers of copies, in plain loops."""
    by = defaultdict(list)
    for i, s, n in docs:
        by[s].append((n, i))
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    size = {s: sum(n for n, _ in by[s]) for s in by}
    capped, total = set(), sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3.0 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if weight[s] * level > 3.0 * size[s]}
        if not more:
            break
        capped |= more
    copies = {}
    for s in order:
        target = 3.0 * size[s] if s in capped else min(weight[s] * level, 3.0 * size[s])
        rows = sorted(by[s])
        rate = target / size[s] if size[s] else 0.0
        u = int(hashlib.md5(f"0:{s if s is not None else chr(0)}".encode()).hexdigest()[:8], 16) / 2**32

        for j, (_, i) in enumerate(rows):
            copies[i] = math.floor((j + 1) * rate + u) - math.floor(j * rate + u)
    return copies


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    train = spark.createDataFrame([(t, a) for i, t, a, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2], "text string, lang string")
    model = langid.fit(train)
    labelled = [(t, a) for i, t, a, _ in docs if a and zlib.crc32(str(i).encode()) % 4 != 2]
    weights = langid_brute.idf([t for t, _ in labelled])
    low = langid_brute.floors(labelled, model, weights)
    kept = []
    for d in docs:
        lang, cos = langid_brute.nearest(d[1], model, weights)
        if lang != "und":
            k = int(math.log2(sum(langid_brute.grams(d[1]).values())))
            shorter = [j for a, j in low if a == lang and j <= k]
            if not shorter or cos >= low[lang, max(shorter)]:
                kept.append(d)
    seen, unique = set(), []
    for d in sorted(kept):
        t = re.sub("[\x20\x09-\x0d]+", " ", d[1] or "")
        if t not in seen:
            seen.add(t)
            unique.append(d)
    sets = []
    for d in unique:
        w = d[1].encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(unique)))
    for i in range(len(unique)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    left = [d for i, d in enumerate(unique) if comp[i] == i]
    copies = brute_mix([(d[0], d[3], len(d[1].encode().split())) for d in left])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = byte_bpe.codec(f.read(), public_tokenizers.PATTERN)._enc
    want = Counter()
    for d in left:
        ids = enc.encode_ordinary(d[1])
        if copies[d[0]]:
            want[d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] = copies[d[0]]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_on_odd_and_no_documents(spark, docs, no_docs):
    for table in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            rows = out.collect()
            if name != "byte_bpe":
                assert out.columns == table.columns
            if table is no_docs:
                assert rows == []
            elif name != "mixing":
                assert 0 < len(rows) <= docs.count()
