"""Secret scans by dictionary-primed zstandard novelty.

A candidate is the value beside a sensitive key (token, password, API key, ...) or a string of a
known credential form, of any length: up to the closing quote or to white space, without the punctuation
that closes it. Its novelty is the number of bytes it adds to a zstandard frame that holds
its surroundings, compressed with a dictionary primed with code words, placeholder values and the
identifiers that the corpus itself uses around such keys, the most widespread last, where matches
are cheapest. What the dictionary or the surroundings already hold compresses away; a random string
does not. Novelty is measured against what a random string of the same length and alphabet carries
(half a byte for a hexadecimal digit); values close to that, or above, are reported. Letters and spaces
alone are measured against a byte a letter, zstandard's price of text that it can't match, so that words
it knows are no secrets. They are judged where a whole sensitive word and ``=`` or ``:`` stand before them;
after a mere space they are a sentence's next word (``the secret ingredient``).

The dictionary counts identifiers around every candidate of the corpus, by documents, without
the candidates' own values, so a leaked value that many copies share stays novel; it is then cut to
``DICTIONARY_BYTES`` because zstandard's window wants it small.

Defined results: a null or empty text has no secrets; every candidate of a text counts, wherever
it stands; repeated rows are reported each; identifiers equally widespread are ordered by themselves;
an empty table gives an empty result; other columns, whatever their names, are ignored by the report
and kept by redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import batches_of

DICTIONARY_BYTES = 16_384
BEFORE, AFTER = 160, 60
LEAST_BYTES = 10
LEAST_NOVELTY = 0.85
LEVEL = 3
REDACTED = "<secret>"

SEED = (
    "import from return function const let var public private static final class def self this null None true false string "
    "int include require export default config settings environment process.env os.environ getenv System.getenv localhost "
    "127.0.0.1 http:// https:// example.com username user password passwd secret token api_key apikey access_key client_secret "
    "private_key authorization bearer credentials changeme change_me example placeholder your_token_here your_api_key_here "
    "your-secret-key YOUR_API_KEY YOUR_TOKEN xxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXX 00000000000000000000 "
    "1234567890123456789012345678901234567890 0123456789abcdef0123456789abcdef abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ password123 qwertyuiop undefined redacted <redacted> ${SECRET} {{ secrets.TOKEN }} dummy test_token test_secret "
    "the and for that with this from your you are not have will must should can cannot please enter here when where which there their about into only "
    "change changed configuration information description documentation authentication authorization administrator application environment development "
    "production international characteristic characteristically organisation organization understand understanding something anything everything nothing "
    "required optional invalid empty missing expired incorrect wrong value string number character characters letters digits minimum maximum length least "
    "never again new old file path name field manager service server client account login reset confirm forgotten stored encrypted hashed random generated "
)
_KEYS = ("token", "secret", "passw", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "private_key", "private-key", "auth", "credential", "bearer", "signature")
_FORMS = ("akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "eyj", "private key-----", "sk-", "sk_live_", "glpat-", "aiza")
_KEYED = re.compile(
    r"(?<![A-Za-z0-9])(?P<key>[A-Za-z0-9_.-]{0,40}?(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|signature)[A-Za-z0-9_.-]{0,40})"
    r"[\"'\]]?[^\S\n]{0,4}(?P<sep>=>|:=|==|=|:|[^\S\n])[^\S\n]{0,4}(?:(?:bearer|basic)[^\S\n]+)?(?:\"(?P<a>(?:[^\"\\\n]|\\.){8,}+)\"|'(?P<b>(?:[^'\\\n]|\\.){8,}+)'|[\"']?(?P<c>[^\s\"'`<>]{8,}+))",
    re.IGNORECASE,
)
_FORMED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?P<a>(?:AKIA|ASIA)[0-9A-Z]{16})|(?P<b>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk[-_](?:live_)?[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})"
    r"|(?P<c>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?P<d>[A-Za-z0-9+/=\s]{16,}?)-----END"
)
_SENSITIVE = re.compile(r"(?i:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credential|bearer|signature)s?(?![a-z])")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,40}")


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of each value to be judged, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    found = []
    if any(k in low for k in _KEYS):
        for m in _KEYED.finditer(text):
            g = m.lastgroup
            value = m[g].rstrip(",;.)]}") if g == "c" else m[g]
            if len(value) >= 8 and (_mixed(value) or (m["sep"].strip() and _SENSITIVE.search(m["key"]))):
                found.append((m.start(g), m.start(g) + len(value), m["key"].lower()))
    if any(k in low for k in _FORMS):
        for m in _FORMED.finditer(text):
            g = m.lastgroup
            found.append((m.start(g), m.end(g), {"a": "cloud key id", "b": "service token", "c": "signed token", "d": "private key"}[g]))
    found.sort()
    kept: list[tuple[int, int, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


class Judge:
    """Novelty against one dictionary."""

    def __init__(self, dictionary: bytes):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False).compress
        self.seen: dict[tuple[str, str], int] = {}

    def marginal(self, around: str, value: str) -> int:
        known = self.seen.get((around, value))
        if known is None:
            if len(self.seen) > 20_000:
                self.seen.clear()
            base = around.encode()
            known = self.seen[around, value] = max(0, len(self.compress(base + value.encode())) - len(self.compress(base)))
        return known

    def secrets(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """``(start, end, key, marginal bytes, novelty)`` of each incompressible candidate."""
        out = []
        for start, end, key in candidates(text):
            value = text[start:end]
            # A value said twice stays novel, also where the surroundings would end within it.
            around = text[max(0, start - BEFORE - len(value)) : start].replace(value, "")[-BEFORE:] + text[end : end + AFTER + len(value)].replace(value, "")[:AFTER]
            added = self.marginal(around + " ", value)
            novelty = added / random_bytes(value)
            if added >= LEAST_BYTES and novelty >= LEAST_NOVELTY:
                out.append((start, end, key, added, novelty))
        return out

    def redact(self, text: str | None) -> str | None:
        if not text:
            return text
        at, parts = 0, []
        for start, end, *_ in self.secrets(text):
            parts += [text[at:start], REDACTED]
            at = end
        return "".join([*parts, text[at:]]) if parts else text


def random_bytes(value: str) -> float:
    """The bytes that a random string of this length over the same alphabet carries."""
    if _PROSE.fullmatch(value):
        return float(len(value.encode()))
    for letters, size in _ALPHABETS:
        if letters.fullmatch(value):
            return len(value) * math.log2(size) / 8
    return float(len(value.encode()))


_ALPHABETS = [(re.compile(p), n) for p, n in ((r"[0-9]+", 10), (r"[0-9a-f]+|[0-9A-F]+", 16), (r"[0-9a-z]+|[0-9A-Z]+", 36), (r"[0-9A-Za-z+/=_-]+", 64), (r"[\x21-\x7e\s]+", 96))]
_PROSE = re.compile(r"(?:[^\W\d_]|[ ,.'’-])+")


def _mixed(value: str) -> bool:
    """Letters with digits, or three kinds of characters: no prose word, whatever stands before it."""
    digit, lower, upper = any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)
    return (digit and (lower or upper)) or (lower and upper and not value.isalpha())


def build_dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The seed with the corpus's own identifiers around candidates, the most widespread last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches_of(batches, "text"):
            words, values = [], []
            for t in texts:
                spans = candidates(t)
                if not spans:
                    continue
                around = set()
                for k, (start, end, _key) in enumerate(spans):
                    left = max([start - BEFORE, 0, *([spans[k - 1][1]] if k else [])])
                    right = min([end + AFTER, len(t), *([spans[k + 1][0]] if k + 1 < len(spans) else [])])
                    around |= set(_IDENTIFIER.findall(t[left:start])) | set(_IDENTIFIER.findall(t[end:right]))
                inside = {w for start, end, _key in spans for w in _IDENTIFIER.findall(t[start:end])}
                for w in around - inside:
                    words.append(w)
                    values.append(0)
                for w in inside:
                    words.append(w)
                    values.append(1)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values, pa.int64())], ["word", "inside"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "word string, inside long").groupBy("word").agg(F.count("*").alias("docs"), F.sum("inside").alias("inside"))
    # What ever stands in a candidate is no identifier; two documents must share one.
    top = counted.where("inside = 0 and docs > 1").orderBy(F.desc("docs"), "word").limit(size // 4).collect()
    chosen, left = [], size - len(SEED)
    for r in top:
        left -= len(r["word"].encode()) + 1
        if left < 0:
            break
        chosen.append(r["word"])
    return (SEED + " ".join(reversed(chosen))).encode()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, key, digest, preview, added_bytes, novelty)`` of each reported string.

    The value itself is not repeated: ``digest`` tells equal ones and ``preview`` has four characters.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dictionary = build_dictionary(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionary)
        for b, texts in batches_of(batches, "text"):
            rows = [(i, s, e, k, hashlib.sha256(t[s:e].encode()).hexdigest()[:16], t[s : s + 4] + "...", n, round(novelty, 3)) for i, t in enumerate(texts) for s, e, k, n, novelty in judge.secrets(t)]
            if rows:
                at, *cols = zip(*rows, strict=True)
                types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "start", "end", "key", "digest", "preview", "added_bytes", "novelty"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, start int, end int, key string, digest string, preview string, added_bytes int, novelty double")


def redactor(docs: DataFrame, text_col: str = "text"):
    """A column function that replaces the secrets of a text, judged against ``docs``."""
    dictionary = build_dictionary(docs, text_col=text_col)

    @F.pandas_udf(StringType())
    def redact(texts: pd.Series) -> pd.Series:
        judge = _judge(dictionary)
        return texts.map(judge.redact, na_action="ignore")

    return redact


_judges: dict[bytes, Judge] = {}


def _judge(dictionary: bytes) -> Judge:
    if dictionary not in _judges:
        _judges.clear()
        _judges[dictionary] = Judge(dictionary)
    return _judges[dictionary]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, secrets in the text replaced."""
    return docs.withColumn(text_col, redactor(docs, text_col)(F.col(text_col)))
