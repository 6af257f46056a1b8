"""Fill-in-middle transformation of texts, cut at words, by bit-parallel big integers.

A text is a sequence of units: a word with the blanks before it, or the blanks at the end.
``bytes.translate`` turns the text into a mask with one bit a byte (a byte of a word or not),
read as one big integer, first byte highest. A word ends where the mask is set and the mask
shifted by one byte is not; ``bit_count`` of these ends gives the number of units, and the end of
the k-th unit is found by halving: the count of the upper half says which half has it. A second
mask, of bytes that begin a code point, turns byte places into code points the same way.

Ranks and forms come from the SHA-256 of seed and id, so that reruns and retried tasks agree. Each row is
transformed alone, in one narrow pass: no shuffle, nothing kept but one text and its masks of an eighth of its size.

Defined cases: null text counts as empty; an empty text, and one that holds a mark, stays plain; a null id
counts as the empty text in the hash; repeated rows give repeated results; an empty table gives an empty
result; very long texts are cut whole; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: In 100: texts that are cut, and cut texts whose suffix stands first.
CUT, SUFFIX_FIRST = 50, 80
_BLANK = b" \t\n\v\f\r"
_IN_WORD = bytes(48 + (b not in _BLANK) for b in range(256))
_BEGINS = bytes(48 + (not 0x80 <= b < 0xC0) for b in range(256))


def mask(text: bytes, table: bytes) -> int:
    """One bit for each byte, the first byte's highest: the digits that table gives them."""
    return int(text.translate(table), 2) if text else 0  # base 2 is read in linear time


def word_ends(text: bytes) -> int:
    """A bit for each last byte of a word."""
    inside = mask(text, _IN_WORD)
    return inside & ~(inside << 1)


def units(text: bytes, ends: int) -> int:
    """The number of units, from the ends of the words."""
    return ends.bit_count() + bool(text and text[-1] in _BLANK)


def place(bits: int, width: int, rank: int) -> int:
    """The index from the top, below width, of the rank-th set bit (from 1)."""
    at = 0
    while width > 1:
        low = width // 2
        upper = bits >> low
        n = upper.bit_count()
        if rank <= n:
            bits, width = upper, width - low
        else:
            bits ^= upper << low
            rank, at, width = rank - n, at + width - low, low
    return at


def cut(text: bytes, ends: int, n: int, rank: int) -> int:
    """The byte after the rank-th of n units."""
    if rank == 0 or rank == n:
        return len(text) if rank else 0
    return place(ends, len(text), rank) + 1


def transformed(text: bytes, h1: int, h2: int, h3: int, h4: int, cut_rate: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = word_ends(text)
    n = units(text, ends)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= cut_rate or p in text or s in text or m in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut(text, ends, n, a), cut(text, ends, n, b)
    begins = mask(text, _BEGINS)
    before_a, before_b = (begins >> (len(text) - a)).bit_count(), (begins >> (len(text) - b)).bit_count()
    if h4 % 100 < suffix_first:
        return n, "spm", before_a, before_b - before_a, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", before_a, before_b - before_a, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def _draws(seed: int, id_col: str) -> list[Column]:
    """The first four groups of eight digits of the hash, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, cut_rate: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: one row per row of df."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(1).cast(pa.large_binary()).to_pylist()
                hashes = zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)
                n, form, before, middle, out = zip(*(transformed(t or b"", *h, cut_rate, suffix_first) for t, h in zip(texts, hashes, strict=True)), strict=True)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(F.col(id_col), F.col(text_col), *_draws(seed, id_col)).mapInArrow(run, T.StructType(fields))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The exact text again. A mark cannot arise where parts meet, as no mark begins inside another."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


#: The same digests in DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us,
        [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS hs FROM d),
c AS (SELECT *, len(us) AS n, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS a, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR hs[3] % 100 >= {CUT} THEN 'plain'
          WHEN hs[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
