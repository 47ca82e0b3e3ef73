"""Personal data: exact base patterns, and bootstrapped contextual extraction that adds to them.

Base entities seed the bootstrap.  Identifier-like strings (occurrences) stand in lexical contexts (the words before
and behind); Spark holds the graph of contexts and strings and scores both sides in turn: a context's confidence for a
kind is the mean score of what stands in it, a string's score the noisy-or of its contexts' confidences, seeds staying
at 1 for their own kind and 0 for the others.  Occurrences of a kind's shape in contexts that end above the threshold
are added.  A base span is never dropped or changed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._store import drop, join_classes, sifted, stored
from loglattice.llm._words import blocks, trim

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.8
UNKNOWN = 0.05  # weight of a string that is no seed in a context's confidence
SUPPORT = 5  # different strings a trusted context must hold

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and anchored at the start of a digit run: the same matches without quadratic retries
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NO_LETTER = re.compile(r"[^\w]|[0-9_]")
_WORD = re.compile(r"\S+")
# each kind's form, spaced groups with one separator throughout; candidates are its matches between delimiters
_FORMS = {
    "email": r"[A-Za-z0-9._%+-]++(?:(?:@|\((?i:at)\)|\[(?i:at)\])[A-Za-z0-9.-]+(?<!\.)|\x20(?:\((?i:at)\)|\[(?i:at)\])\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "ip": r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}(?<!\.)",
    "card": r"(?:[0-9][0-9.-]{11,22}[0-9]|[0-9]{4}(?:\x20[0-9]{2,7}){2,4})",
    "phone": r"(?:\+?\(?[0-9][0-9().-]{5,16}[0-9]|\+?(?:[0-9]{1,3}\x20)?(?:\([0-9]{1,5}\)\x20[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,4}|[0-9]{2,5}(?:\x20[0-9]{2,5}){1,5}))",
}
_SHAPES = {k: re.compile(form) for k, form in _FORMS.items()}
_EDGE = r"\s,;\"'<>()\[\]{}|="
_CANDIDATES = {k: re.compile(rf"(?<![^{_EDGE}:]){form}(?=[.!?:]*+(?:[{_EDGE}]|\Z))") for k, form in _FORMS.items()}
_LEAST = {"email": 0, "ip": 1, "card": 10, "phone": 7}  # digits
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_HIT = np.zeros(256, bool)
_HIT[[*range(0x30, 0x3A), 0x40]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def _byte(digits: str) -> bool:
    """Whether the number, however many zeros lead it, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; failing ones dropped without a retry; kinds as listed, by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _shaped(kind: str, string: str) -> bool:
    return sum(c in "0123456789" for c in string) >= _LEAST[kind] and bool(_SHAPES[kind].fullmatch(string))


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that no base span touches and that lie in no longer one."""
    found = {m.span() for k, form in _CANDIDATES.items() if k != "email" or _AT.search(text) for m in form.finditer(text) if _shaped(k, m[0])}
    out, last = [], -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if b > last and not any(x < b and a < y for _, x, y in spans):
            out.append((a, b))
            last = b
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _letters(word: str) -> str:
    """The word's letters, lower-cased; long ones by a digest."""
    letters = _NO_LETTER.sub("", word.lower())
    return letters if len(letters) <= 48 else hashlib.blake2b(letters.encode(errors="replace"), digest_size=16).hexdigest()


def _contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """For each span, the words right before and behind; empty at the text's ends.

    A word that reaches up to a span without white space counts from the nearest other span on.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    stops, starts = sorted(b for _, b in spans), sorted(a for a, _ in spans)
    out = []
    for start, end in spans:
        at = bisect_left(begins, start) - 1
        k = bisect_right(stops, start) - 1
        before = text[max(words[at][0], stops[k] if k >= 0 else 0) : min(words[at][1], start)] if at >= 0 else ""
        at = bisect_right(ends, end)
        k = bisect_left(starts, end)
        behind = text[max(words[at][0], end) : min(words[at][1], starts[k] if k < len(starts) else len(text))] if at < len(words) else ""
        out.append((_letters(before), _letters(behind)))
    return out


_SPANS = "doc_id long, text_hash long, base array<struct<kind:string,start:long,stop:long>>, near array<struct<kind:string,start:long,stop:long,string:string,context:string>>"


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row, and its occurrences with their contexts (kind null: an identifier-like string)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    near_type = pa.struct([*span, ("string", pa.string()), ("context", pa.string())])

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            hit = np.zeros(len(column), bool)
            for at, offsets, data in blocks(column, 2 << 20):
                marks = np.concatenate(([0], np.cumsum(_HIT[data])))
                hit[at : at + len(offsets) - 1] = np.diff(marks[offsets]) > 0
            for sign in ("(at)", "[at]"):
                hit |= pc.match_substring(column, sign, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
            base, near = [[]] * len(column), [[]] * len(column)
            for i in np.flatnonzero(hit).tolist():
                text = column[i].as_py()
                spans = base_spans(text)
                base[i] = [{"kind": k, "start": a, "stop": b} for k, a, b in spans]
                rows = [(k, a, b) for k, a, b in spans]
                rows += [(None, a, b) for a, b in candidates(text, spans)]
                found = []
                for (k, a, b), (left, right) in zip(rows, _contexts(text, [(a, b) for _, a, b in rows]), strict=True):
                    digest = hashlib.blake2b(text[a:b].encode(), digest_size=16).hexdigest()
                    shapes = "".join(str(j) for j, kind in enumerate(KINDS) if _shaped(kind, text[a:b]))
                    for context in (f"<{left}", f">{right}", f"<{left}>{right}"):
                        if len(context) > 2:
                            found.append({"kind": k, "start": a, "stop": b, "string": f"{digest}{shapes}", "context": context})
                near[i] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(near, pa.list_(near_type))], ["doc_id", "text_hash", "base", "near"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _SPANS)


def _bootstrap(scanned: DataFrame) -> DataFrame:
    """Added spans (doc_id, text_hash, kind, start, stop) from the graph of contexts and strings.

    Contexts and strings in many edges meet their scores by join_classes, so none is gathered in one task.
    """
    seen = scanned.select("doc_id", "text_hash", F.explode("near").alias("o")).select("doc_id", "text_hash", "o.*")
    edges = seen.groupBy("context", "string").agg(F.count("*").alias("n"), F.max("kind").alias("seed"))
    edges = stored(edges, "edges")
    total, scores, trusted = edges.count(), edges.withColumn("lift", F.lit(None).cast("array<double>")), None
    weight = F.col("n") * F.when(F.col("seed").isNull(), UNKNOWN).otherwise(1.0)
    for _ in range(ROUNDS):
        # a seed scores 1 for its kind and 0 for others; an unknown string starts at 0
        own = [F.when(F.col("seed").isNotNull(), (F.col("seed") == k).cast("double")).otherwise(F.coalesce(F.get("lift", F.lit(i)), F.lit(0.0))) for i, k in enumerate(KINDS)]
        trust = [F.when((F.sum(s * weight) / F.sum(weight) >= CONFIDENCE) & (F.count_if(s >= CONFIDENCE) >= SUPPORT), F.sum(s * weight) / F.sum(weight)).otherwise(0.0) for s in own]
        held = scores.groupBy("context").agg(F.array(*trust).alias("trust"), F.count("*").alias("m"), F.sum("n").alias("seen"))
        before, trusted = trusted, stored(held.where(F.exists("trust", lambda c: c > 0)), "contexts")
        unknown = join_classes(edges.where("seed is null").select("context", "string"), trusted.select("context", "trust", "m"), "context", "m", total).where("trust is not null")
        lift = [1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.get("trust", F.lit(i)))))) for i in range(len(KINDS))]
        lifts = unknown.groupBy("string").agg(F.array(*lift).alias("lift"), F.count("*").alias("m"))
        scores = join_classes(edges, lifts, "string", "m", total)
        if before is not None:
            drop(before)
    rows = edges.agg(F.sum("n")).first()[0] or 0
    placed = join_classes(seen.where("kind is null").drop("kind"), trusted.select("context", "trust", "seen"), "context", "seen", rows).where("trust is not null")
    shaped = [F.struct(F.when(F.substring("string", 33, 4).contains(str(i)), F.get("trust", F.lit(i))).otherwise(0.0).alias("c"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]
    best = placed.withColumn("best", F.array_max(F.array(*shaped))).where("best.c > 0")
    return best.groupBy("doc_id", "text_hash", "start", "stop").agg(F.max("best")["kind"].alias("kind")).select("doc_id", "text_hash", "kind", "start", "stop")


def _ordered(spans) -> F.Column:
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, added): arrays of (kind, start, stop) in code points for every row of docs."""
    scanned = stored(_scan(docs), "spans")
    keyed = _bootstrap(scanned).where("doc_id is not null")
    added = keyed.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    empty = F.array().cast("array<struct<kind:string,start:long,stop:long>>")
    return scanned.drop("near").join(added, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "base", F.coalesce("added", empty).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    docs(doc_id, text, ...): counts and base_sha256 are of the base spans, spans holds added ones too.  Whole texts of any
    length are searched; a null or empty text has no span; repeated rows give the same row each; a null doc_id's row gets
    base spans only; other columns are ignored; an empty table gives no rows.
    """
    found = find_spans(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(_ordered(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _ordered(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of ``text`` replaced by its kind in brackets; all columns and rows stay.

    Overlapping spans are replaced as one, by the kind of the first; n_chars, if there, is counted again where the text
    changed.  Columns may have any names; null and empty texts stay, repeated rows stay and are changed alike, a null
    doc_id's row loses its base spans; texts of any length are read whole; an empty table gives no rows.
    """
    names = docs.columns
    spans = find_spans(docs).where("size(base) + size(added) > 0").select("doc_id", "text_hash", F.concat("base", "added").alias("spans"))
    # a row for each text, as repeated rows have equal spans
    spans = stored(spans.groupBy("doc_id", "text_hash").agg(F.max("spans").alias("spans")), "redactions")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("id"))
    may, cannot = sifted(rows, spans.select(F.col("doc_id").alias("id")), "id")
    own = F.xxhash64(F.col("row")["text"])
    met = may.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (own == F.col("text_hash")), "left").select("row", "spans")
    whole, place = cannot.select("row.*"), names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def changed(text: str, found: list[dict]) -> str:
        parts, at = [], 0
        for span in sorted(found, key=lambda s: (s["start"], s["stop"], s["kind"])):
            if span["start"] >= at:
                parts += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
            at = max(at, span["stop"])
        return "".join([*parts, text[at:]])

    def run(batches):
        for whole_batch in batches:
            for first in range(0, len(whole_batch), 2_000):  # few texts at once
                batch = whole_batch.slice(first, 2_000)
                columns, found = batch.column(0).flatten(), batch.column(1).to_pylist()
                rows = [i for i, own in enumerate(found) if own]
                mask = np.zeros(len(batch), bool)
                mask[rows] = True
                texts = [changed(columns[place][i].as_py(), found[i]) for i in rows]
                columns[place] = pc.replace_with_mask(columns[place], pa.array(mask), pa.array(texts, columns[place].type))
                if count is not None:
                    columns[count] = pc.replace_with_mask(columns[count], pa.array(mask), pa.array([len(t) for t in texts], columns[count].type))
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return whole.unionByName(met.mapInArrow(run, docs.schema)).select(*(F.col(f"`{c}`") for c in names))
