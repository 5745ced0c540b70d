"""Secret scans: keyword prefilter, anchored patterns near its hits, embedded checksums.

An Aho-Corasick automaton finds keywords in the lower-cased text; at each hit
one anchored pattern is matched on the original text. Kinds with an embedded
checksum (the tokens of code hosts and package registries end in six base-62
digits of a CRC32) count only if it holds. Runs of hex digits have no keyword;
their own character class, tested at every fourth character, is the prefilter.

Base kinds (leftmost, non-overlapping within a kind; short matches are dropped
but still consume text): assign, access, hex. Added kinds: github, npm, card
(a number after a card keyword whose Luhn digit holds).

Defined results: a null text counts as empty and has no spans. Spans are in code
points, end exclusive. A null id is reported as null, repeated rows each. An
empty table gives an empty one. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, map_rows, named, sliced, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "card")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = {"github": re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
_CARD = re.compile(r"""(?:card|visa|mastercard|amex)(?:[ _-]?(?:number|no|num))?["']?\x20*[:=#]?\x20*["']?((?:[0-9][ -]?){12,18}[0-9])(?![0-9])""", re.I | re.A)
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword: the kind whose pattern starts there.
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", **{f"gh{c}_": "github" for c in "pousr"}, "npm_": "npm", "card": "card", "visa": "card", "amex": "card", "mastercard": "card"}

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out.rjust(6, "0")


def card_ends(run: str) -> list[int]:
    """Ends of the digit groups up to which the run has 13 digits or more, longest first: an expiry date may follow the number."""
    ends = [g.end() for g in re.finditer("[0-9]+", run)]
    return [e for e in reversed(ends) if sum(c not in " -" for c in run[:e]) >= 13]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 16 hex digits or more. Such a run covers four fourth characters in a row."""
    kind = 1 if text.isascii() else 4
    chars = np.frombuffer(text.encode("ascii" if kind == 1 else "utf-32-le", "surrogatepass"), np.uint8 if kind == 1 else np.uint32)
    fourth = chars[::4]
    h = _HEX_BYTE[fourth] if kind == 1 else (_HEX_BYTE[np.minimum(fourth, 127)] & (fourth < 128))
    if len(h) < 4:
        return []
    near = np.flatnonzero(h[:-3] & h[1:-2] & h[2:-1] & h[3:])
    out, done = [], -1
    for i in near.tolist():
        at = i * 4
        if at < done:
            continue
        while at > max(done, 0) and text[at - 1] in "0123456789abcdef":
            at -= 1
        m = _HEX.match(text, at)
        done = m.end()
        if m.end() - m.start() >= 16:
            out.append((m.start(), m.end()))
    return out


def scan(text: str | None, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind as listed."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so places stay
    for end, (n, kind) in sorted(((e, v) for e, v in words.iter(lower)), key=lambda x: (x[0] - x[1][0], -x[1][0])):
        at = end - n + 1
        if at < done[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, at)
            if m:
                done[kind] = m.end()
                if len(m[2]) >= 12:
                    out.append((kind, at, m.end()))
        elif kind == "access":
            m = _ACCESS.match(text, at)
            if m:
                done[kind] = m.end()
                if m.end() - at >= 18:
                    out.append((kind, at, m.end()))
        elif kind == "card":
            m = _CARD.match(text, at)
            for end in card_ends(m[1]) if m else ():
                if luhn(re.sub("[ -]", "", m[1][:end])):
                    done[kind] = m.start(1) + end
                    out.append((kind, m.start(1), m.start(1) + end))
                    break
        else:
            m = _TOKEN[kind].match(text, at)
            if m and base62_crc(m[2]) == m[3]:
                done[kind] = m.end()
                out.append((kind, at, m.end()))
    out += [("hex", a, b) for a, b in _hex_spans(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row."""
    bound_batches(df.sparkSession)
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        words = automaton()
        for b in sliced(batches, 1):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, words)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, struct)], ["id", "spans"])

    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def mask_secrets(df: DataFrame, text_col: str = "text", with_: str = "<secret>") -> DataFrame:
    """The rows of df with every span replaced in the text; null texts stay null."""
    bound_batches(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches):
        words = automaton()
        for b in sliced(batches, place):
            texts = []
            for t in b.column(place).to_pylist():
                done, parts = 0, []
                for _, s, e in scan(t, words):
                    if e > done:
                        parts += [t[done:s], with_] if s >= done else []
                        done = e
                texts.append(t if t is None else "".join(parts) + t[done:])
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return map_rows(df, run)


def _digest(spans: DataFrame) -> list:
    def joined(kinds):
        rows = F.filter("spans", lambda x: x["kind"].isin(list(kinds)))
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(number, BASE), F.sha2(joined(BASE), 256).alias("base_sha256"), joined(KINDS).alias("spans")]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *_digest(out))


QUERIES = {"op3_secrets": op3_secrets}
ORACLES: dict[str, str] = {}
