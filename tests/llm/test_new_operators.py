"""Line dedup, releases and fill-in-middle against brute force, on odd and on no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import fill_in_middle, line_dedup, releases

BLANK = " \t\n\v\f\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

# 11


def key_of(line):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    return k if len(k) >= 20 else None


def brute_lines(rows, least=3):
    has = defaultdict(list)
    for i, t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")} - {None}:
            has[k].append(i)
    stays = {k: max((i for i in ids if i is not None), default=None) for k, ids in has.items() if len(ids) >= least}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in stays or stays[key_of(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.fixture(scope="module")
def lined(rows):
    rng = random.Random(5)
    shared = [f"a line that several documents share, number {i}" for i in range(30)] + ["é" * 19, "é" * 20, "ÉÀ" * 10, "x" * 19, "y" * 20, "long " * 40000]
    out = [(r[0], r[1]) for r in rows]
    for i in range(200, 290):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"line {i} {j} of this document alone" for j in range(rng.randint(1, 9))]
        lines += ["", "  \t", "the line of nearly all documents"] if i % 5 else []
        out.append((i, "\n".join(rng.choice([x, f" {x}\r", x.upper() if x.isascii() else x]) for x in lines)))
    return out + out[-3:] + [(None, "\n".join(shared[:4])), (None, shared[0])]


def test_line_dedup(spark, lined, monkeypatch):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("_id", "_key", "_text", "_lose", "n_lines"))])
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in lined], schema).repartition(3)
    rows = lambda out: Counter(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect())
    want = brute_lines(lined)
    assert sum(n for (_, _, lost, _), n in want.items() if lost) > 50
    assert rows(line_dedup.drop_repeated_lines(df)) == want
    assert rows(line_dedup.drop_repeated_lines(df, least_docs=5)) == brute_lines(lined, 5)
    # filters that let much through, and tasks that send several, change nothing
    monkeypatch.setattr(line_dedup, "FLUSH", 7)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 2048)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 2048)
    assert rows(line_dedup.drop_repeated_lines(df)) == want


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.drop_repeated_lines(no_docs).collect() == []
    with pytest.raises(ValueError, match="two documents"):
        line_dedup.drop_repeated_lines(no_docs, least_docs=1)


def test_filters_miss_no_repeat(spark):
    texts = [f"a line with a number in it: {i}" for i in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:500]], "text string").repartition(4)
    bitmap = line_dedup.repeated_filter(df)
    found = [line_dedup.digests(t.encode())[0] for t in texts]
    known = set(line_dedup.suspected(found, bitmap))
    assert set(found[:500]) <= known and len(known) < 700


# 12


def brute_conversation(conv, turns):
    """turns: (turn, text) in order; rows of the result, second by second from the definition."""
    h = lambda k, t: zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if t is None else t}".encode())
    got = []
    for p, (t, _) in enumerate(turns):
        d = h(0, t) % 7
        parent = got[p - d] if 0 < d <= p else None
        if parent and parent[0] != "delivered":
            got.append(("blocked", 0, None, None))
            continue
        at = first = max(7 * p, parent[3]) if parent else 7 * p
        for a in range(1, 5):
            if not (h(1, t) % 101 < 20 and (at < 7 * p + h(2, t) % 101 or h(a + 2, t) % 3 == 0)):
                got.append(("delivered", a, first, at))
                break
            if a == 4:
                got.append(("dead", 4, first, at))
            else:
                at += 20 * 2 ** (a - 1)
    order = sorted((r[3], p) for p, r in enumerate(got) if r[0] == "delivered")
    number, state, total = {}, {}, 0
    for n, (_, p) in enumerate(order, 1):
        total += n * zlib.crc32((turns[p][1] or "").encode())
        number[p], state[p] = n, (total + 2**63) % 2**64 - 2**63
    return [(conv, t, *got[p], number.get(p), state.get(p)) for p, (t, _) in enumerate(turns)]


def brute_releases(rows):
    by = defaultdict(list)
    for c, t, text in rows:
        by[c].append((t, text))
    out = Counter()
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
        out.update(brute_conversation(c, turns))
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["hello", "", None, "été", "x" * 3000])) for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    rows += [(100, t * 3, f"turn {t}") for t in range(700)] + [(101, t, f"{t}") for t in range(90)] + [(None, t, "n") for t in range(20, 60)]
    return rows + [(3, 2, "again"), (3, 2, "again"), (3, None, "no number"), (102, 5, "alone")]


COLUMNS = ("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


def released(df, *args):
    return Counter(tuple(r) for r in releases.quarantine(df, *args).select(*COLUMNS).collect())


def test_releases(spark, talk):
    schema = "conv_id long, turn long, text string, crc string, p string, status string, _c string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in talk], schema).repartition(3)
    want = brute_releases(talk)
    assert {r[2] for r in want} == {"delivered", "dead", "blocked"}
    assert released(df) == want
    assert releases.quarantine(df.filter("false")).collect() == []


@pytest.mark.parametrize(("block", "halo"), [(16, 8), (50, 0)])
def test_long_conversations_are_replayed_in_blocks(spark, talk, block, halo, monkeypatch):
    """Halos that are too small are widened, and releases are numbered through spans and runs of spans."""
    monkeypatch.setattr(releases, "FAN", 3)
    df = spark.createDataFrame(talk, "conv_id long, turn long, text string").repartition(3)
    assert released(df, block, halo) == brute_releases(talk)


def test_state_wraps(spark):
    wide = spark.createDataFrame([(2**63 - 1, 2**62, 5)], "a long, b long, c long").select(releases._wrapped(releases._wide("a") + releases._wide("b") * releases._wide("c")).alias("x"))
    assert wide.first().x == (2**63 - 1 + 2**62 * 5 + 2**63) % 2**64 - 2**63


# 13

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_fim(i, t):
    t = t or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    digits = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, rows):
    odd = ["", " ", "a", " a", "a ", "\n\na\t", "a<b <", "<P", "x <S> y", "<M>", "P> <", "日本 語 の 文 ", "  \x85", "< <<P <S <M P>S>", "a\x00b \x1c c"]
    own = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i in range(40) for t in odd]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("_h0", "n", "form", "output"))])
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in own], schema).repartition(3)
    out = fill_in_middle.fill_in_middle(df).withColumn("again", fill_in_middle.restored())
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out.collect())
    want = Counter((i, *brute_fim(i, t), t or "") for i, t in own)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert got == want
    assert fill_in_middle.fill_in_middle(df.filter("false")).collect() == []
    always = fill_in_middle.fill_in_middle(df, cut_rate=100, suffix_first=0).groupBy("form").count().collect()
    assert {r["form"] for r in always} == {"plain", "psm"}


def test_ranked_bits():
    rng = random.Random(1)
    for width in (1, 2, 3, 64, 65, 1000):
        for _ in range(20):
            bits = rng.getrandbits(width) | 1
            ones = [i for i, c in enumerate(f"{bits:0{width}b}") if c == "1"]
            assert [fill_in_middle.place(bits, width, k + 1) for k in range(len(ones))] == ones


# names of columns, in all stages that give rows back


def test_columns_of_any_name_keep_their_values(docs, rows):
    """Every row that comes back holds, by value, the extra columns of a row that went in."""
    from siltstone.llm import exact_dedup, jaccard_join, mixing

    marked = docs
    extra = [c for c in docs.columns if c not in {"doc_id", "text", "lang", "source", "n_chars"}]
    for i, c in enumerate(extra):
        marked = marked.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for out in (exact_dedup.survivors(marked), jaccard_join.representatives(marked), mixing.mix(marked, (1, 2, 3), 3.0)):
        found = out.collect()
        assert out.columns == docs.columns and found
        for r in found:
            assert [r[c] for c in extra] == [f"{i}:{'none' if r.doc_id is None else r.doc_id}" for i in range(len(extra))]


def test_text_ids_of_pages_come_back(spark, tmp_path):
    from siltstone.llm import warc

    ids = ["none", None, "", "a\r\nPage: b", "é \"x\"", "%0A+"]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    out = warc.digests(warc.read_archive(spark, path)).collect()
    assert {r.page_id for r in out} == set(ids)
    assert {(r.record_type, r.refers_to) for r in out} == {("response", None), ("revisit", "")}


# 3, inserts


def _entries(spark, index):
    return sorted((r.key, r.text_sha256, r.keep_id, r.group_size, r.n_bytes) for r in index.read(spark).collect())


def test_inserts_equal_one_build(spark, monkeypatch):
    from siltstone.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "CAPACITY", 8)
    rows = [(i, f"text {i % 450}") for i in range(900)] + [(None, "text 3"), (None, "no id at all"), (5000, None)]
    df = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    build = lambda d: exact_dedup.build_index(d, exact_dedup.text_facts(d))
    whole = build(df(rows))
    index = build(df(rows[:100]))
    depth = index.depth
    for at in (100, 500, 700):
        index = exact_dedup.insert(index, df(rows[at : {100: 500, 500: 700, 700: 1000}[at]]))
    assert _entries(spark, index) == _entries(spark, whole)
    assert index.depth > depth and index.directory(spark).count() == 1 << index.depth
    # the same buckets: no other keys together than in one build
    held = lambda x: {frozenset(k) for k in x.read(spark).groupBy("bucket").agg(F.collect_set("key").alias("k")).toPandas()["k"].map(tuple)}
    assert held(index) == held(whole)
    facts = exact_dedup.text_facts(df(rows))
    of = lambda x: Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.probe(x, facts).collect())
    assert of(index) == of(whole) and sum(of(index).values()) == len(rows)
    assert exact_dedup.insert(index, df([])) is index


def test_an_insert_rewrites_only_the_page_of_its_bucket(spark, monkeypatch):
    from siltstone.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "CAPACITY", 8)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    index = exact_dedup.build_index(df, exact_dedup.text_facts(df))
    before = {r.bucket: r.page for r in index.directory(spark).collect()}
    files = set(index.read(spark).inputFiles())
    more = exact_dedup.insert(index, spark.createDataFrame([(7000, "one more text")], "doc_id long, text string"))
    after = {r.bucket: r.page for r in more.directory(spark).collect()}
    moved = {before[b] for b in before if after[b] != before[b]}
    assert len(moved) == 1 and len(set(before.values())) > 10
    kept = set(more.read(spark).inputFiles())
    assert len(files - kept) == 1 and {f for f in kept - files if int(f.split("page=")[1].split("/")[0]) < index.pages} == set()
    assert exact_dedup.probe(index, exact_dedup.text_facts(df)).count() == 300  # the old directory still finds its pages


def test_splitting_ends_where_the_directory_of_one_build_does():
    from siltstone.llm import exact_dedup

    rng = random.Random(2)
    counts = Counter(rng.getrandbits(18) >> rng.choice([0, 0, 4]) for _ in range(3000))
    g, slots = exact_dedup.directory(counts, 18, 16)
    h, other, parents = exact_dedup.split(0, np.zeros(1, np.int32), counts, 16, 18)
    assert g == h and np.array_equal(np.diff(slots) != 0, np.diff(other) != 0) and set(parents.values()) == {0}
