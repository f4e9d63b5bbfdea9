"""The ordered rewriting of reads, call after call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mods import phred

_CHANGE = "array<struct<reference_pos:bigint,old_base:string,new_base:string,probability:float>>"


def rewrite(seq: str, qual: str | None, edits: list[dict] | None) -> tuple[str, str | None, list[tuple]]:
    letters, marks, changes = list(seq), list(qual) if qual else None, []
    for e in edits or []:
        old = letters[e["position"]].upper()
        if old not in "ACGT":
            continue
        options = [(max(0, int(e[b])), k, b) for k, b in enumerate("ACGT") if b != old]
        new = min(options)[2]
        letters[e["position"]] = new
        p = None if e["probability"] is None or e["probability"] != e["probability"] else float(e["probability"])
        if marks is not None and (q := phred(p)) is not None:
            marks[e["position"]] = chr(q + 33)
        changes.append((int(e["ref_position"]), old, new, p))
    return "".join(letters), "".join(marks) if marks else qual, changes


def fold_calls(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    @F.pandas_udf(f"struct<seq:string,qual:string,changes:{_CHANGE}>")
    def fold(seq: pd.Series, qual: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = [rewrite(s or "", q, None if e is None else list(e)) for s, q, e in zip(seq, qual, edits)]
        keys = ("reference_pos", "old_base", "new_base", "probability")
        return pd.DataFrame({"seq": [r[0] for r in rows], "qual": [r[1] for r in rows], "changes": [[dict(zip(keys, c)) for c in r[2]] for r in rows]})

    done = reads.withColumn("r", fold("seq", "qual", "edits"))
    new = done.select(*(c for c in reads.columns if c not in ("seq", "qual", "edits")), F.col("r.seq").alias("seq"), F.col("r.qual").alias("qual"))
    changes = done.select("contig", "read_id", F.explode("r.changes").alias("c")).select("contig", "c.reference_pos", "read_id", "c.old_base", "c.new_base", "c.probability")
    return new, changes
