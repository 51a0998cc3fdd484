"""Secrets by fixed patterns and by dictionary-primed compression novelty.

*Base spans* are the matches of three patterns (leftmost, non-overlapping per kind):
assignments of six or more characters to a secret-like name, access keys, long hexadecimal runs.

*Novelty.*  A candidate is a token of ``MIN_TOKEN`` or more characters of the base-64
alphabet with letters and digits, near a sensitive word.  Its marginal bytes are what it adds to the
size of its compressed surroundings: zstandard, primed with a dictionary of
identifiers (fixed ones, and the most frequent words of all documents),
compresses the text around it without and with the token, after a run of known identifiers that keeps
short surroundings from being stored plain.  Two kinds of controls stand in the same place: random
tokens of the same length and alphabet, and one letter repeated.  Novelty is where the
token lies between them, 0 at the repetition and 1 at the random ones, so what the frame costs cancels.
A token of ``NOVELTY`` or more is reported as ``novel``
if it touches no base span.  Base spans always stay.

The dictionary has at most ``DICTIONARY_BYTES``; finding spans shuffles nothing, counting words
shuffles one count per word and task (or per ``COUNTED_WORDS`` words).

Defined results: null text counts as empty; offsets are code points, ends exclusive;
repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = 3
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(pattern: str) -> str:
    """ASCII letters of a pattern in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


ASSIGN = re.compile(f"""({'|'.join(map(_either_case, NAMES))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Words that make their surroundings sensitive, and common identifiers.
SENSITIVE = ("key", "secret", "token", "passw", "pwd", "auth", "credential", "private", "bearer", "signature", "login")
IDENTIFIERS = (
    "import export from return function const let var def class self this public private static final void int string "
    "boolean true false null none print value values name names index count length size type types object array list "
    "dict map set get put post delete request response config settings options params args kwargs environ getenv "
    "username user users email host port url uri path file files folder client server session connect connection "
    "database table column row query select insert update where http https www com org net example localhost api key "
    "secret token password passwd credential authorization bearer basic access refresh private public certificate "
    "BEGIN END RSA PRIVATE KEY AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY DATABASE_URL SECRET_KEY API_KEY API_TOKEN "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 1234567890 "
    "UserName UserId FromDatabase ToString GetValue SetValue KeyValue ListItem MapEntry ArrayList RequestHandler ResponseBody "
    "ClientId ServerName SessionToken ConfigFile SettingsManager OptionsBuilder ServiceFactory ControllerBase ComponentType "
    "ConnectionString PasswordHash SecretKey AccessToken IndexCount LengthSize DataType FilePath HostPort TimeStamp DateTime "
    "VersionNumber DefaultTable ColumnName UpdateCreate DeleteInsert SelectFind LoadSave ReadWrite OpenClose StartStop "
    "user_name user_id from_database connection_string password_hash secret_key access_token session_id file_path time_stamp "
    "date_time version_number default_table column_name created_at updated_at is_valid max_length min_value _general_ci signature header nonce digest "
    "utf8 utf8mb4 ascii latin1 unicode sha1 sha256 sha512 md5 base64 hmac rsa2048 aes128 aes256 int8 int16 int32 int64 uint8 "
    "uint32 uint64 float32 float64 http1 http2 oauth2 x509 ipv4 ipv6 v1 v2 v3 2018 2019 2020 2021 2022 2023 2024 2025")

MIN_TOKEN = 16
CONTEXT = 48             # characters before a token in which a sensitive word counts
AROUND = 256             # characters on either side that the token is measured against
NOVELTY = 0.75           # between the controls
CONTROLS = 5             # random tokens measured beside a candidate
COUNTED_WORDS = 200_000  # words that a task counts before it hands the counts on
DICTIONARY_WORDS, DICTIONARY_BYTES = 4000, 48_000
LEVEL = 19
FRAME = IDENTIFIERS[:400] + " "      # known text before the surroundings

_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,23}")
_SENSITIVE = re.compile("|".join(map(_either_case, SENSITIVE)))
_MAYBE = (f"({'|'.join(map(_either_case, NAMES))})[\"']? *[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"
          f"|({'|'.join(map(_either_case, SENSITIVE))})(.|\\n){{0,{CONTEXT}}}[A-Za-z0-9+/_-]{{{MIN_TOKEN}}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by start, then kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda s: (s[1], s[0]))


# --------------------------------------------------------------------- novelty
class NoveltyMeter:
    """Marginal compressed bytes of a token against its surroundings and controls."""

    def __init__(self, dictionary: bytes):
        # zstandard weighs the end of a raw dictionary most
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.packer = zstandard.ZstdCompressor(dict_data=content, compression_params=params)

    def marginal_bytes(self, around: str, tokens: list[str]) -> list[int]:
        """What each token adds after the surroundings."""
        plain = (FRAME + around).encode("utf-8", "replace")
        bare = len(self.packer.compress(plain))
        return [len(self.packer.compress(plain + t.encode())) - bare for t in tokens]

    def novelty(self, around: str, token: str) -> float:
        """0: no more than a repeated letter, 1: as much as random tokens of its length and alphabet."""
        dull, own, *random_ones = self.marginal_bytes(around, [token[0] * len(token), token, *random_tokens(token)])
        usual = sorted(random_ones)[len(random_ones) // 2]
        return (own - dull) / max(1, usual - dull)


def alphabet(token: str) -> str:
    """The characters that a token like this one is drawn from."""
    body = token.rstrip("=")
    for whole in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(body) <= set(whole):
            return whole
    groups = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_-")
    return "".join(g if i < 3 else "".join(sorted(set(g) & set(body))) for i, g in enumerate(groups) if set(g) & set(body))


def random_tokens(token: str) -> list[str]:
    """CONTROLS random tokens of the same length and alphabet; the same for the same token."""
    rng, letters = random.Random(zlib.crc32(token.encode())), alphabet(token)
    return ["".join(rng.choices(letters, k=len(token))) for _ in range(CONTROLS)]


@lru_cache(maxsize=2)
def _meter(dictionary: bytes) -> NoveltyMeter:
    return NoveltyMeter(dictionary)


def novel_spans(text: str, taken: list[tuple[int, int]], meter: NoveltyMeter) -> list[tuple[int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
            continue
        if any(m.start() < e and s < m.end() for s, e in taken):
            continue
        if not _SENSITIVE.search(text, max(0, m.start() - CONTEXT), m.start()):
            continue
        around = text[max(0, m.start() - AROUND): m.start()] + text[m.end(): m.end() + AROUND]
        if meter.novelty(around, token) >= NOVELTY:
            out.append((m.start(), m.end()))
    return out


def find_spans(text: str, dictionary: bytes) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    added = [(3, s, e) for s, e in novel_spans(text, [(s, e) for _, s, e in base], _meter(dictionary))]
    return base, sorted(base + added, key=lambda s: (s[1], s[0]))


def span_string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# ------------------------------------------------------------------- operator
def learn_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """Identifiers and the most frequent words of all documents, the commonest last; what could be a
    candidate itself (long, with digits) is never among them."""
    def counted(words):
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                          ["word", "n"])

    def count(batches):
        words = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                words.update(w for w in _WORD.findall(value or "") if len(w) < MIN_TOKEN or w.isalpha())
                if len(words) >= COUNTED_WORDS:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    # the counts are written once; the classes of their size tell which can be among the first
    counts = cut_lineage(docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
                         .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word_counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("class")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, enough = 0, 0
    for size in sorted(sizes, key=lambda r: -r["class"]):
        least, enough = size["class"], enough + size["words"]
        if enough >= DICTIONARY_WORDS:
            break
    # at most DICTIONARY_WORDS and one more class of size are sorted
    top = (counts.where(F.floor(F.log2("n")) >= least).orderBy(F.col("n").desc(), "word").limit(DICTIONARY_WORDS).collect())
    learned = " ".join(r.word for r in reversed(top)).encode()[-DICTIONARY_BYTES + len(IDENTIFIERS) + 1:]
    return learned + b" " + IDENTIFIERS.encode()


def find_secrets(docs: DataFrame, dictionary: bytes, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts per kind, digest of the base spans, all spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            maybe = pc.fill_null(pc.match_substring_regex(column, _MAYBE), False).to_pylist()
            counts, digest, spans = np.zeros((batch.num_rows, BASE_KINDS), np.int64), [], []
            for row, hit in enumerate(maybe):
                if not hit:
                    digest.append(nothing)
                    spans.append("")
                    continue
                base, every = find_spans(column[row].as_py(), dictionary)
                for kind, _, _ in base:
                    counts[row, kind] += 1
                digest.append(hashlib.sha256(span_string(base).encode()).hexdigest())
                spans.append(span_string(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(BASE_KINDS)), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_query(docs: DataFrame) -> DataFrame:
    return find_secrets(docs, learn_dictionary(docs))
