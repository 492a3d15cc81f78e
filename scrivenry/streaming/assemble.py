"""Streaming answers: pieces are released at sentence ends, references are checked, NOT_FOUND is held back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_END = re.compile(r"[.!?]\s")
_REF = re.compile(r"\[(\d{1,3})\]")


def released(pieces: list[str], known: int) -> list[str]:
    """What may be shown after each piece, the rest after the last: whole sentences without unknown references.

    Nothing leaves while all there is could still become NOT_FOUND; such an answer is never shown.
    """
    clean = lambda s: _REF.sub(lambda m: m.group(0) if 1 <= int(m.group(1)) <= known else "", s)
    held, out, shown = "", [], False
    for piece in pieces:
        held += piece
        if not shown and "NOT_FOUND".startswith(held.strip()[:9]):
            out.append("")
            continue
        ends = [m.end() for m in _END.finditer(held)]
        cut = ends[-1] if ends else 0
        out.append(clean(held[:cut]))
        shown, held = shown or cut > 0, held[cut:]
    last = held.strip().strip(".").strip()
    out.append("" if not shown and last == "NOT_FOUND" else clean(held))
    return out


def assembled(pieces: DataFrame, known: int) -> DataFrame:
    """(answer_id, seq, shown) from pieces (answer_id, seq, piece); an answer is one request's output, so a small group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        out = released(rows.piece.tolist(), known)
        return pd.DataFrame({"answer_id": rows.answer_id.iloc[0], "seq": [*rows.seq.tolist(), int(rows.seq.max()) + 1], "shown": out})

    return pieces.groupBy("answer_id").applyInPandas(run, "answer_id long, seq long, shown string")
