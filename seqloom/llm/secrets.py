"""Secret scans: fixed patterns, plus zstandard novelty of strings in sensitive context.

A string of `shortest` characters or more that lies within `reach` of a sensitive word, before or after it, or
goes on from such a string as a line of one block, is measured by its marginal compressed bytes: a frame
holding the surrounding code, `around` characters on either side, followed by the string, less a frame
holding the surrounding code alone, both primed with a dictionary of common identifiers. Names and prose
repeat something the dictionary or the surroundings already hold and cost little; key material costs nearly its
full length. Strings whose marginal bytes reach `novelty` of their length are reported beside the fixed
patterns. What a sensitive word or a fixed pattern covers is measured no further. These four numbers are
parameters of scan() and redact(), with the defaults of Context; they say what sensitive context is, and hold
alike at every size of text and corpus. The time a text takes grows with its length.

A null text counts as an empty one and has no spans. Repeated rows give equal results; every
column of the input other than the id and the text is left out, so clashing names cannot arise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "novel")

# Words that make a context sensitive, and identifiers that prime the dictionary.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[\s_-]?key|auth|credential|bearer|private[\s_-]?key|access[\s_-]?key|signature", re.IGNORECASE | re.ASCII)
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey api-key access_key secret_key private_key public_key authorization authentication authenticate "
    "credential credentials bearer signature session_id user_name username client_id client_secret config configuration environment variable default example placeholder "
    "return function class import export const static public private protected string integer boolean undefined null none true false self this value values "
    "https://www. http://localhost .com .org .json .yaml index.html /usr/local/ /var/lib/ getElementById addEventListener toString document.window request response header "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 xxxxxxxx XXXXXXXX ________ ======== ........ --------"
)
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: What may lie between two lines of one key block, and the short last line of an armoured one.
BETWEEN = re.compile(r"""[\s"',;\\>#*|]*""")
TAIL = re.compile(r"""[\s"',;\\>#*|]+([A-Za-z0-9+/=]+)(?=[\s"',;\\>#*|]+-----END)""")


@dataclass(frozen=True)
class Context:
    """What is measured: strings of at least `shortest` characters within `reach` of a sensitive word, against `around` characters on either side; reported from `novelty` marginal bytes a byte."""

    shortest: int = 16
    reach: int = 64
    around: int = 1024
    novelty: float = 0.6


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and the identifier dictionary."""

    def __init__(self, level: int = 3):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frame = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def marginal(self, around: str, candidate: str) -> int:
        ground = around.encode()
        return len(self.frame.compress(ground + b"\n" + candidate.encode())) - len(self.frame.compress(ground + b"\n"))

    def ratio(self, around: str, candidate: str) -> float:
        return self.marginal(around, candidate) / max(1, len(candidate.encode()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive_runs(text: str, words: list[tuple[int, int]], context: Context) -> list[tuple[int, int]]:
    """Runs that are long enough and near a sensitive word on either side, and those that go on from such a run as lines of one block."""
    runs = [(m.start(), m.end()) for m in RUN.finditer(text) if m.end() - m.start() >= context.shortest] if words else []
    near, at = [], 0
    for start, end in runs:
        while at < len(words) and words[at][1] + context.reach <= start:
            at += 1
        near.append(at < len(words) and words[at][0] - context.reach < end)
    follows = [k > 0 and BETWEEN.fullmatch(text, runs[k - 1][1], runs[k][0]) is not None for k in range(len(runs))]
    for k in range(1, len(runs)):
        near[k] |= near[k - 1] and follows[k]
    for k in range(len(runs) - 1, 0, -1):
        near[k - 1] |= near[k] and follows[k]
    return [run for run, chosen in zip(runs, near, strict=True) if chosen]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, context: Context = Context()) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context, without what sensitive words and base spans cover of them."""
    found: list[tuple[int, int, int]] = []
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    covered = sorted(words + [(s, e) for s, _, e in base])
    first = 0
    for start, end in sensitive_runs(text, words, context):
        pieces, at = [], start
        while first < len(covered) and covered[first][1] <= start:
            first += 1
        k = first
        while k < len(covered) and covered[k][0] < end:
            s, e = covered[k]
            if e > at:
                pieces.append((at, s))
                at = e
            k += 1
        for s, e in [*pieces, (at, end)]:
            if e - s < context.shortest:
                continue
            around = text[max(0, s - context.around) : s] + text[e : e + context.around]
            if novelty.ratio(around, text[s:e]) >= context.novelty:
                found.append((s, 3, e))
                tail = TAIL.match(text, e) if e == end else None
                if tail and len(tail[1]) < context.shortest:
                    found.append((tail.start(1), 3, tail.end(1)))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: Context = Context()) -> DataFrame:
    """One row per input row: the id, spans array<struct<kind,start,end>> in code points (end exclusive).

    Texts are scanned whole and one by one, within the partitions of the input: there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + novel_spans(text or "", base, measure, context))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "spans"])

    id_type = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", context: Context = Context(), mask: str = "[SECRET]") -> DataFrame:
    """df with each span of its texts, overlapping ones merged, replaced by a mask; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts):
        import pandas as pd

        measure, out = Novelty(), []
        for text in texts:
            if text:
                base = base_spans(text)
                at, parts = 0, []
                for start, _, end in sorted(base + novel_spans(text, base, measure, context)):
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                text = "".join(parts) + text[at:] if parts else text
            out.append(text)
        return pd.Series(out, dtype=object)

    return df.withColumn(text_col, masked(text_col))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's spans."""

    def text_of(chosen):
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return spans.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
