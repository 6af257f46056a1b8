"""Near pairs by parts of word sets: all pairs and no others, whatever meets, and little that is moved."""

import random

import pytest

from siltstone.operators import dedup, parts
from siltstone.plans import catalog


def brute(docs, threshold):
    sets = {i: set((t or "").lower().split()) for i, t in docs.items()}
    found = {}
    for a in sets:
        for b in sets:
            if a < b and docs[a] != docs[b] and sets[a] and sets[b]:
                score = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if score >= threshold:
                    found[a, b] = score
    return found


def texts(rng, n):
    """Texts of 1 to 60 of few words, most of them changed copies of others in a few words."""
    out = []
    for _ in range(n):
        words = rng.choice(out).split() if out and rng.random() < 0.7 else [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.85, 1.0])
def test_pairs_are_all_pairs(spark, monkeypatch, threshold):
    docs = dict(enumerate(dict.fromkeys(texts(random.Random(7), 240))))
    docs |= {500 + i: " ".join(reversed(docs[i].split())) + " " for i in range(9)}  # other texts of the same words
    want = brute(docs, threshold)
    assert len(want) >= (9 if threshold == 1 else 20)
    monkeypatch.setattr(parts, "BLOCK", 8)  # groups are cut into squares
    df = spark.createDataFrame(list(docs.items()) + [(999, None), (998, ""), (997, docs[3])], "doc_id long, text string").repartition(3)
    found = dedup.near_pairs(df, "doc_id", "text", threshold).collect()
    assert {(r.a, r.b): round(r.score, 9) for r in found} == {k: round(v, 9) for k, v in want.items()} and len(found) == len(want)


def test_an_id_of_several_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j x"), (3, "k l m n o p q r s t y"), (2, "a b c d e f g h i j x")]
    found = dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 0.85).collect()
    assert sorted((r.a, r.b) for r in found) == [(1, 2), (1, 3)]


def test_words_that_many_sets_have_bring_nothing_together(spark):
    """Sets of 40 words of 400, so that each word is in every tenth set: prefixes of words bring nearly all pairs together, parts hardly any."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.sample(range(400), 40))) for i in range(600)]
    docs += [(600 + i, t + " new") for i, t in docs[:5]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    text = df.select("doc_id", parts.spaced(df.text).alias("words")).withColumnRenamed("doc_id", "id")
    tells, total = parts.rarity(text)
    assert total >= 605 * 40
    named = parts.named_parts(text, 0.85, tells)
    assert named.count() < 605 * 40
    assert sorted((r.a, r.b) for r in parts.met(named, 0.85, 4).collect()) == [(i, 600 + i) for i in range(5)]
    assert dedup.near_pairs(df, "doc_id", "text", 0.85).count() == 5


def test_no_text_is_not_merged_with_an_empty_one(spark, tmp_path):
    rows = [(1, None, "s", 0), (2, "", "t", 0), (3, None, "u", 1), (4, "a b", "u", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["dup_merge"](spark, str(tmp_path)).collect()
    assert {(r.component, r.id, r.merged) for r in out} == {(1, 3, 2), (2, 2, 1), (4, 4, 1)}
