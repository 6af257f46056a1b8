"""Token counts of a word-end BPE vocabulary by a whole-token shortcut.

Offline, on the driver and once for a tokenizer file, two things are proven with the library itself: which vocabulary
strings are one pre-token and encode alone as one token, and on which characters the pattern of
the file, as run here, and the library's own splitting agree (every assigned
character is split beside a letter, a digit and a mark; that shows its class, and the
pattern looks at nothing but classes and a few ASCII strings). Tasks get both proofs.

A text is normalised by the library (ASCII text by lower-casing, which is all that the normaliser does to
it), split into pre-tokens, and pre-tokens in the set count one each; only the rest are
merged, each different one once per batch of memory. Texts with a character outside the
proof, or with the string of a special token, are counted by the library itself.

Defined cases: null and empty texts have 0 tokens; repeated rows are each counted; an empty
table gives an empty result; very long texts are counted whole; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_TOKENIZER_FILE = 64 << 20
#: Pre-tokens that are remembered per worker before the memory starts afresh.
MEMO = 200_000
#: A character is tried as "a?1?. ".
_PROBE = 6

_cache: dict[bytes, TokenCounter] = {}


def _split_pattern(spec: dict) -> str:
    return next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]


def _signatures(spans: np.ndarray, probes: int) -> np.ndarray:
    """A number for each probe that says where its pre-tokens begin and how long they are."""
    out = np.zeros(probes, np.int64)
    np.bitwise_or.at(out, spans[:, 0] // _PROBE, np.int64(1) << (spans[:, 0] % _PROBE * _PROBE + np.minimum(spans[:, 1] - spans[:, 0], _PROBE - 1)))
    return out


def agreed_characters(tok, pattern: str) -> np.ndarray:
    """Bits of the characters of which the library and the pattern here have the same class."""
    import regex

    assigned = regex.compile(r"[^\p{Cn}\p{Co}\p{Cs}]+")
    find = regex.compile(pattern).finditer
    agreed = np.zeros(0x110000, bool)
    for lo in range(0, 0x110000, 0x4000):
        chars = "".join(assigned.findall("".join(chr(i) for i in range(lo, lo + 0x4000) if not 0xD800 <= i < 0xE000)))
        if chars:
            text = "".join(f"a{c}1{c}. " for c in chars)
            here = np.array([m.span() for m in find(text)])
            there = np.array([at for _, at in tok.pre_tokenizer.pre_tokenize_str(text)])
            same = _signatures(here, len(chars)) == _signatures(there, len(chars))
            agreed[np.frombuffer(chars.encode("utf-32-le"), np.uint32)[same]] = True
    return np.packbits(agreed)


@dataclass
class Proof:
    """A tokenizer file and what was proven of it."""

    raw: bytes
    single: frozenset[str]
    agreed: np.ndarray


def prove(raw: bytes) -> Proof:
    """The proofs, for the tokenizer file in raw."""
    from tokenizers import Tokenizer, decoders

    counter = TokenCounter(Proof(raw, frozenset(), np.zeros(0x110000 // 8, np.uint8)))
    spec, tok = json.loads(raw), Tokenizer.from_str(raw.decode())
    counter.agreed = np.unpackbits(agreed_characters(tok, _split_pattern(spec))).astype(bool)
    end, plain = spec["model"].get("end_of_word_suffix") or "", decoders.ByteLevel()
    words = [plain.decode([v[: len(v) - len(end)]]) for v in spec["model"]["vocab"] if end and v.endswith(end)]
    words = [w for w in words if w and "\ufffd" not in w and counter.safe(w) and counter.find(w) == [w]]
    single = frozenset(w for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1)
    return Proof(raw, single, np.packbits(counter.agreed))


class TokenCounter:
    """Counts tokens as the library does for the tokenizer file of a proof."""

    def __init__(self, proof: Proof):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(proof.raw)
        self.tok = Tokenizer.from_str(proof.raw.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        pattern = _split_pattern(spec)
        self.find = regex.compile(pattern).findall
        # in lower-case ASCII the classes are these; the standard library is faster there
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.lowers = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo: dict[str, int] = {}
        self.single, self.agreed = proof.single, np.unpackbits(proof.agreed).astype(bool)
        self.by_library = self.merged = 0

    def safe(self, text: str) -> bool:
        """Whether all characters are within the proof."""
        return bool(self.agreed[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].all())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self._library(text)
        if self.lowers and text.isascii():
            if not self.safe(text):
                return self._library(text)
            found = self.find_ascii(text.lower())
        else:
            norm = self.tok.normalizer.normalize_str(text)
            if not norm:
                return 0
            if not self.safe(norm):
                return self._library(text)
            found = self.find(norm)
        total, single, memo = 0, self.single, self.memo
        for pre, k in Counter(found).items():
            if pre in single:
                total += k
                continue
            n = memo.get(pre)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = memo[pre] = len(self.tok.encode(pre, add_special_tokens=False).ids)
                self.merged += 1
            total += k * n
        return total

    def _library(self, text: str) -> int:
        self.by_library += 1
        return len(self.tok.encode(text, add_special_tokens=False).ids)


def counter(proof: Proof) -> TokenCounter:
    key = hashlib.sha256(proof.raw).digest()
    if key not in _cache:
        _cache[key] = TokenCounter(proof)
    return _cache[key]


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The file's proofs, made here, for all tasks: at most MAX_TOKENIZER_FILE bytes and its own strings."""
    with open(path, "rb") as f:
        raw = f.read(MAX_TOKENIZER_FILE + 1)
    if len(raw) > MAX_TOKENIZER_FILE:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_FILE} bytes")
    return spark.sparkContext.broadcast(prove(raw))


def count_tokens(df: DataFrame, tokenizer: Broadcast, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        c = counter(tokenizer.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(1).to_pylist()
                n = [c.count(t) for t in texts]
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
