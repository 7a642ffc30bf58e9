"""Result tables as delimited files: analysis reports, receptor tables, guide models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.sinks.text import write_delimited

#: Columns of a rearrangement table in the public AIRR form.
AIRR = ("sequence_id", "sequence", "rev_comp", "productive", "v_call", "d_call", "j_call", "c_call", "junction", "junction_aa", "cdr3", "cdr3_aa", "cell_id", "duplicate_count", "consensus_count", "locus")


def airr(receptors: DataFrame) -> DataFrame:
    """receptors in AIRR columns; those that are not there are empty, and booleans are T and F."""
    have = {c.lower(): k for c, k in receptors.dtypes}
    cols = []
    for c in AIRR:
        if c not in have:
            cols.append(F.lit("").alias(c))
        elif have[c] == "boolean":
            cols.append(F.when(F.col(c), "T").when(~F.col(c), "F").otherwise("").alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return receptors.select(*cols)


def write_reports(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """A TSV folder for each table; arrays become comma-joined text. Gives the folders."""
    out = []
    for name, df in tables.items():
        flat = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c, k in df.dtypes if k.startswith("array<") and "struct" not in k}
        write_delimited(df.withColumns(flat), f"{folder}/{name}", sep="\t")
        out.append(f"{folder}/{name}")
    return out


def write_airr(receptors: DataFrame, folder: str) -> None:
    write_delimited(airr(receptors), folder, sep="\t", missing="")
