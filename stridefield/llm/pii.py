"""Personal data: base rules seed a bootstrapped extractor that learns the contexts of identifiers.

Base spans (email, ip, card, phone) are found by rule in every text. They are the seed entities.
Words beside them induce lexical patterns; Spark scores the graph of patterns and instances in
rounds: a pattern is as good as the mean score of the instances seen in it, an instance as likely as
its good patterns together make it. Instances without a rule that end up likely become spans of kind
``id``. Base spans always stay.

Candidates are words of any length with at least ``min_digits`` digits (four by default, which is what
counts as identifier-like here). Long values and context words stand in the graph as digests of the whole. Only narrow rows are shuffled: edges are combined
to (pattern, instance, count) before any join, so a frequent pattern is one row per instance.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, cut, merged

KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
DIGITS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGE = "\"'.,;:!?()[]{}<>#*$%&|=+-_/"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string())])
SPAN_SQL = "start long, end long, kind string, value string, left string, right string"


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it, in one pass over long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), code points, end exclusive, sorted by start, then kind as listed."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def _word(piece: str) -> str:
    return piece.strip(EDGE).lower()


def _named(text: str) -> str:
    """The text, or a digest of all of it where it is long; words here never begin with #."""
    return text if len(text) <= 64 else "#" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _scan_text(text: str, min_digits: int = 4) -> tuple[list[tuple[int, int, str]], list[tuple]]:
    """Base spans, and all identifier-like spans with the words beside them (kind null: no rule)."""
    enough = re.compile(r"(?:[0-9][^0-9]*){%d}" % min_digits)
    if min_digits and not MARK.search(text):
        return [], []
    base = base_spans(text)
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    seen: list[tuple] = []

    def beside(start: int, end: int) -> tuple[str, str]:
        i, j = bisect_right(starts, start) - 1, bisect_left(starts, end)
        left = text[tokens[i - 1][0] : tokens[i - 1][1]] if i > 0 else ""
        right = text[tokens[j][0] : tokens[j][1]] if j < len(tokens) else ""
        return _named(_word(left)), _named(_word(right))

    for s, e, kind in base:
        seen.append((s, e, kind, _named(text[s:e]), *beside(s, e)))
    b = 0
    for s, e in tokens:
        while b < len(base) and base[b][1] <= s:
            b += 1
        if any(x[0] < e and x[1] > s for x in base[b : b + 4]):
            continue
        piece = text[s:e]
        if enough.search(piece):
            inner = piece.strip(EDGE)
            if inner:
                s += piece.index(inner)
                seen.append((s, s + len(inner), None, _named(inner), *beside(s, s + len(inner))))
    return base, seen


def _scan(batches: Iterator[pa.RecordBatch], min_digits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, seen = [], []
        for text in batch.column(2).to_pylist():
            b, c = _scan_text(text or "", min_digits)
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
            seen.append([dict(zip(("start", "end", "kind", "value", "left", "right"), x, strict=True)) for x in c])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
                pa.array(seen, pa.list_(SPAN)),
            ],
            ["doc_id", "_th", "base", "seen"],
        )


def scan(docs: DataFrame, min_digits: int = 4) -> DataFrame:
    """One row per document: doc_id (of any type), _th (xxhash64 of the text), base spans, identifier-like spans with contexts."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), "text")
    return keyed.mapInArrow(
        lambda batches: _scan(batches, min_digits),
        f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, _th long, base array<struct<start:long,end:long,kind:string>>, "
        f"seen array<struct<{SPAN_SQL.replace(' ', ':').replace(',:', ',')}>>",
    )


def likely_instances(
    seen: DataFrame, scratch: Scratch, rounds: int | None = None, min_support: int = 3, min_score: float = 0.9, settled: float = 1e-6
) -> DataFrame:
    """value of the instances without a rule that good contexts make likely, each once.

    ``seen`` has value, kind (null: no rule), left, right. A pattern is the word before, the word
    after, or both. It counts once ``min_support`` different instances score at least ``min_score`` in
    it and the mean score of all its instances is at least ``min_score``. Scores never fall from round to round;
    the rounds end when none rises by more than ``settled`` (or after ``rounds``). Each asks the driver for one row.
    """
    both = F.filter(
        F.array(
            F.when(F.col("left") != "", F.concat(F.lit("L "), "left")),
            F.when(F.col("right") != "", F.concat(F.lit("R "), "right")),
            F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", F.lit("B"), "left", "right")),
        ),
        lambda p: p.isNotNull(),
    )
    every = scratch.keep(
        seen.select("value", F.col("kind").isNotNull().alias("seed"), F.explode(both).alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed"))
    )
    # a pattern of fewer instances can never count
    usable = every.groupBy("pattern").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_support).select("pattern")
    scored = scratch.keep(every.join(usable, "pattern").withColumn("score", F.col("seed").cast("double")))
    done = 0
    while rounds is None or done < rounds:
        good = (
            scored.groupBy("pattern")
            .agg(F.avg("score").alias("good"), F.sum((F.col("score") >= min_score).cast("long")).alias("support"))
            .filter((F.col("good") >= min_score) & (F.col("support") >= min_support))
            .select("pattern", "good")
        )
        likely = (
            scored.filter(~F.col("seed"))
            .join(good, "pattern")
            .groupBy("value")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("good")))))).alias("likely"))
        )
        new = F.greatest("score", F.when(~F.col("seed"), F.coalesce("likely", F.lit(0e0))).otherwise(F.lit(1e0)))
        scored = scratch.keep(
            scored.join(likely, "value", "left").select("pattern", "value", "seed", new.alias("score"), (new > F.col("score") + settled).alias("rose"))
        )
        done += 1
        if scored.filter("rose").isEmpty():
            break
    # seeds count as found by their rule, in whatever pattern they stand
    seeds = every.filter("seed").select("value").distinct()
    return scored.filter((F.col("score") >= min_score) & ~F.col("seed")).select("value").distinct().join(seeds, "value", "left_anti")


def _found(docs: DataFrame, scratch: Scratch, min_digits: int, **settings) -> DataFrame:
    """_row, _th, base and spans of every row of ``docs`` (text, and _row)."""
    scanned = scratch.keep(scan(docs.select(F.col("_row").alias("doc_id"), "text"), min_digits).withColumnRenamed("doc_id", "_row"))
    seen = scanned.select("_row", F.explode("seen").alias("s")).select("_row", "s.*")
    likely = likely_instances(seen, scratch, **settings)
    more = (
        seen.filter(F.col("kind").isNull())
        .join(likely, "value", "left_semi")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "end", F.lit("id").alias("kind"))).alias("more"))
    )
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    joined = scanned.select("_row", "_th", "base").join(more, "_row", "left").withColumn(
        "_all", F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")))
    )
    in_order = F.transform(
        F.array_sort(
            F.transform(
                "_all",
                lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return joined.select("_row", "_th", "base", in_order.alias("spans"))


def find(docs: DataFrame, min_digits: int = 4, **settings) -> DataFrame:
    """doc_id, base and spans (array<struct<start, end, kind>>, sorted): every row of ``docs`` (doc_id, text) once.

    Null text is empty and has no spans. Repeated rows have the same spans each. Every row keeps its own
    result, whatever its doc_id. No rows give no rows. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        # the id travels beside the row's number, so the scan's table has both
        rows = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col("doc_id").alias("d")).alias("_row"), "text")
        return cut(_found(rows, scratch, min_digits, **settings).select("_row.d", "base", "spans").withColumnRenamed("d", "doc_id"))


def described(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans, kind: str) -> F.Column:
    """How many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and spans:
                parts, at = [], 0
                for s in spans:
                    if s["end"] > at:  # overlapping spans are hidden together, under the first one's kind
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"<{s['kind']}>"]
                        at = s["end"]
                text = "".join(parts) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]]
        )


def redact(docs: DataFrame, scratch: Scratch, min_digits: int = 4, **settings) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets. Null text stays null, all columns stay.

    Documents are numbered and written to ``scratch``; the result reads it, so write that before it is removed.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_doc"), "text"))
    spans = scratch.keep(_found(rows, scratch, min_digits, **settings).filter(F.size("spans") > 0).select("_row", "spans"))
    joined = merged(rows, spans, ["_row"], "left").select("text", "spans", "_doc")
    done = joined.mapInArrow(_redact, f"text string, _doc {rows.schema['_doc'].dataType.simpleString()}")
    return done.select(*[F.col("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])
