"""PII (4): spans by pattern, and those that a character-level BiLSTM with CRF transitions adds."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import STAGE_BATCH, byte_batches, narrow
from .pii_model import WINDOW, BiLstmCrf, encode, trained
from .pii_rules import _LOCAL, KINDS, base_spans, is_card, luhn

#: `plausible` lets no span of any kind pass that has neither a digit nor a sign for "at", so windows without one of these can't add a span and
#: are left out; all others are read.
TRIGGER = re.compile(r"[0-9]+|@|[(\[]at[)\]]")
CONTEXT = 28
#: Windows of a long stretch overlap by half.
STRIDE = WINDOW // 2
WINDOWS_AT_ONCE = 512

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?:(?:\.|[(\[]dot[)\]])[A-Za-z0-9-]+)+")
_DOMAIN_GOES_ON = re.compile(r"[A-Za-z0-9-]*(?:(?:\.|[(\[]dot[)\]])[A-Za-z0-9-]+)*")
_IP = re.compile(r"([0-9]{1,3})(?:\[\.\]|\.| \. )([0-9]{1,3})(?:\[\.\]|\.| \. )([0-9]{1,3})(?:\[\.\]|\.| \. )([0-9]{1,3})")
_PHONE = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")


def plausible(kind: int, found: str) -> bool:
    """What a span of the kind must look like, wider than the patterns."""
    if kind == 0:
        return bool(_EMAIL.fullmatch(found))
    if kind == 1:
        m = _IP.fullmatch(found)
        return bool(m) and all(int(p) <= 255 for p in m.groups())
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 2:
        return is_card(found) if re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", found) else False
    return bool(_PHONE.fullmatch(found)) and 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", found)) and not (len(digits) >= 13 and luhn(digits))


#: What a span is drawn in to, for each kind, where the labels reach a little further than the datum.
_FORMATS = (_EMAIL, _IP, re.compile(r"[0-9](?:[ .-]?[0-9])+"), _PHONE)


def snapped(text: str, kind: int, a: int, b: int, cut: bool) -> tuple[int, int]:
    """A labelled stretch set to the ends of its words, then to the datum of that form within it."""
    low, high = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
    while a > low and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < high and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    found = _FORMATS[kind].search(text, a, b)
    if found:
        a, b = found.span()
    # An address may be longer than any window; spans of other kinds are whole in another one.
    return whole_address(text, a, b, cut) if kind == 0 and TRIGGER.search(text, a, b) else (a, b)


def whole_address(text: str, a: int, b: int, cut: bool) -> tuple[int, int]:
    """An address found in a window, grown in the text: to the start of its local part, and on in its domain where it was cut."""
    while a > 0 and text[a - 1] in _LOCAL:
        a -= 1
    if b < len(text) and (cut or text[b].isalnum()):
        b = _DOMAIN_GOES_ON.match(text, b).end()
    return a, b


def windows(text: str) -> list[tuple[int, int]]:
    """(start, end) of windows that together hold every trigger with its context, each `WINDOW` characters long where the text is.

    Windows of a longer stretch overlap by half.
    """
    out, n = [], len(text)

    def close(start: int, end: int) -> None:
        spare = max(0, WINDOW - (end - start))
        start = max(0, min(start - spare // 2, n - WINDOW))
        out.append((start, min(n, start + WINDOW)))
        while out[-1][1] < end:
            start = min(start + STRIDE, n - WINDOW)
            out.append((start, start + WINDOW))

    start = end = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(n, m.end() + CONTEXT)
        # Stretches that would end up in one window, or meet, go together.
        if start >= 0 and a > end and b - start > WINDOW:
            close(start, end)
            start = a
        elif start < 0:
            start = a
        end = max(end, b)
    if start >= 0:
        close(start, end)
    return out


def reconcile(base: list[tuple[int, int, int]], found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Of the spans found in any window, those without an overlap that weigh most together; none overlaps a base span.

    Weighted interval scheduling over the whole text, by end.
    """
    # Base spans of different kinds may overlap each other; as merged stretches they are in order.
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts = [t[0] for t in taken]

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return i == 0 or taken[i - 1][1] <= s

    spans = sorted((e, s, k, w) for (k, s, e), w in found.items() if free(s, e))
    ends, best = [x[0] for x in spans], [(0.0, -1, 0)]  # value, span, where to go on from
    for i, (_, s, _, w) in enumerate(spans):
        j = bisect_left(ends, s + 1, 0, i)
        with_it = best[j][0] + w
        best.append((with_it, i, j) if with_it > best[-1][0] else (best[-1][0], -1, i))
    out, at = [], len(spans)
    while at > 0:
        _, i, j = best[at]
        if i >= 0:
            e, s, k, _ = spans[i]
            out.append((k, s, e))
        at = j
    return sorted(out)


def spans_in_windows(model: BiLstmCrf, texts: list[str], cut: list[tuple[int, int, int]]) -> list[dict]:
    """For each text: plausible spans with their weight, over all of its windows (text, start, end)."""
    found: list[dict] = [{} for _ in texts]
    by_length: dict[int, list] = {}
    for c in cut:
        by_length.setdefault(c[2] - c[1], []).append(c)
    for some in (of[at : at + WINDOWS_AT_ONCE] for of in by_length.values() for at in range(0, len(of), WINDOWS_AT_ONCE)):
        labels, margins = model.decode(np.stack([encode(texts[t][s:e]) for t, s, e in some]))
        for row in np.flatnonzero(labels.any(axis=1)).tolist():
            t, s, e = some[row]
            line = labels[row, : e - s].tolist()
            i = 0
            while i < len(line):
                if line[i] == 0:
                    i += 1
                    continue
                k, j = (line[i] - 1) // 2, i + 1
                while j < len(line) and line[j] == 2 + 2 * k:
                    j += 1
                a, b = s + i, s + j
                margin = float(margins[row, i:j].mean())
                at_end, i = j == len(line), j
                # The labels say where something is; of which kind it is, its form may know better.
                for k in (k, *(x for x in (2, 1, 3) if k > 0 and x != k)):
                    place = snapped(texts[t], k, a, b, at_end)
                    if plausible(k, texts[t][slice(*place)]):
                        a, b = place
                        break
                alone = (a == 0 or not texts[t][a - 1].isalnum()) and (b == len(texts[t]) or not texts[t][b].isalnum())
                if alone and plausible(k, texts[t][a:b]):
                    found[t][k, a, b] = max(found[t].get((k, a, b), 0), (1 + margin) * (b - a))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(model: BiLstmCrf, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind and start."""
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    found = spans_in_windows(model, texts, [(i, *w) for i, t in enumerate(texts) for w in windows(t)])
    return [(b, sorted(b + reconcile(b, f)) if f else b) for b, f in zip(base, found, strict=True)]


def _rows(model: BiLstmCrf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = find_spans(model, batch.column(1).to_pylist())
            of_base, of_all = ([pa.array([sum(s[0] == k for s in x[i]) for x in both], pa.int64()) for k in range(len(KINDS))] for i in (0, 1))
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both])
            spans = pa.array([joined(s) for _, s in both], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *of_all, digest, spans, *of_base], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"base_{k}" for k in KINDS)])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_email, base_ip, base_card, base_phone): one row per row of ``docs``, in one scan.

    Spans by pattern always stay (`pii_rules`).  The model reads overlapping windows that hold every digit run and sign for "at" of the
    whole text, since no kind is without one; what a text gives does not depend on the texts it is read with; an address cut by a window is grown to its ends; what is found is checked for its kind and reconciled over the text
    (`reconcile`).  Counts n_* are of all spans, base_* of those by pattern; places are code points, ends exclusive.

    A null text is empty and has no spans; null or repeated ids stay; an empty table gives an empty one; further columns are
    ignored.
    """
    byte_batches(docs.sparkSession, STAGE_BATCH)
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of_all, of_base = (", ".join(f"{x}_{k} long" for k in KINDS) for x in ("n", "base"))
    return rows.mapInArrow(_rows(trained()), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {of_all}, base_sha256 string, spans string, {of_base}")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind's name; where spans overlap, the first one names the stretch."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with personal data masked in the text; a null text stays null; cases as of `personal_data`."""
    byte_batches(docs.sparkSession, STAGE_BATCH)
    model, at, names = trained(), docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = find_spans(model, [t or "" for t in texts])
            masked = pa.array([None if t is None else mask(t, s) for t, (_, s) in zip(texts, spans, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), masked)

    numbered = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    schema = StructType([StructField(f.name, f.dataType, True) for f in numbered.schema.fields])
    return numbered.mapInArrow(run, schema).toDF(*names)
