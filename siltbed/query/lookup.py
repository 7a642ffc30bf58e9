"""Plans of the lookup language over a catalog of DataFrames.

Catalog tables (0-based half-open coordinates): genes(gene_id, names, chr, start, end, strand), transcripts(tx_id, names,
gene_id, chr, strand, bases, cds_bases), proteins(protein_id, accession, entry, name, symbol, ensp, names, tx_ids, gene_id),
features(feature_id, label, kind, description, signature, chr, strand, blocks, source, aa_start, aa_end, tx_id),
variants(chr, pos, id, ref, alts), clinical(chr, pos, ref, alt). Names are arrays; they match without case and version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.relations import chromosome_key, strip_version
from siltbed.query.language import CHROMOSOME, POSITION, Query, QueryError, Range, parse, validate

Catalog = dict[str, DataFrame]


def _identities(query: Query, fields: Sequence[str]) -> list[str]:
    """All text values of the fields: several identity predicates unite, though joined by AND."""
    out = []
    for p in query.predicates:
        if p.field in fields:
            for v in p.values:
                if not isinstance(v, str):
                    raise QueryError(f"{p.field} takes text")
                out.append(v)
    return list(dict.fromkeys(out))


def _equal_text(query: Query, fields: Sequence[str]) -> str | None:
    """The first = value, by the order of the fields; IN isn't read here."""
    return next((p.values[0] for f in fields for p in query.predicates if p.field == f and p.kind == "eq" and isinstance(p.values[0], str)), None)


def _position(query: Query) -> tuple[int, int]:
    for p in query.predicates:
        if p.field in POSITION and p.kind == "eq":
            v = p.values[0]
            if isinstance(v, Range):
                return v.start, v.end
            if isinstance(v, int) and v >= 1:
                return v, v
    raise QueryError(f"{query.entity} query requires position = N or start:end")


def _names_match(names: Column, wanted: Sequence[str]) -> Column:
    keys = sorted({w.lower() for w in wanted} | {w.lower().rsplit(".", 1)[0] for w in wanted if w.rsplit(".", 1)[-1].isdecimal()})
    hit = lambda n: F.lower(n).isin(keys) | strip_version(F.lower(n)).isin(keys)
    return F.exists(names, hit)


def _must_resolve(found: DataFrame, wanted: Sequence[str], what: str, all_of_them: bool) -> None:
    """A small look-up on the wanted names only, ahead of the result: unknown identities are errors."""
    got = {n.lower() for r in found.select("names").collect() for n in r["names"]}
    bare = got | {n.rsplit(".", 1)[0] for n in got}
    missing = [w for w in wanted if w.lower() not in got and w.lower().rsplit(".", 1)[0] not in bare]
    if missing and (all_of_them or len(missing) == len(wanted)):
        raise QueryError(f"{what} {missing[0]!r} is not known")


def genes(query: Query, catalog: Catalog) -> DataFrame:
    """By identity (position is ignored then; a protein stands for its gene), else by chromosome and position."""
    table = catalog["genes"]
    columns = [F.col("chr").alias("chromosome"), (F.col("start") + 1).alias("start"), "end", "gene_id", F.array_join("names", ",").alias("names"), "strand"]
    wanted = _identities(query, ("name", "id", "symbol"))
    if wanted:
        own = table.where(_names_match(F.col("names"), wanted))
        names = own.select("gene_id", "names")
        if "proteins" in catalog:
            names = names.unionByName(catalog["proteins"].where(_names_match(F.col("names"), wanted)).select("gene_id", "names"))
        _must_resolve(names, wanted, "identity", True)
        return table.join(names.select("gene_id").distinct(), "gene_id", "left_semi").select(*columns).orderBy("gene_id")
    chrom = _equal_text(query, CHROMOSOME)
    if chrom is None:
        raise QueryError("gene query requires name or chromosome and position")
    start, end = _position(query)
    hit = table.where((chromosome_key(F.col("chr")) == chromosome_key(F.lit(chrom))) & (F.col("start") < end) & (F.col("end") > start - 1))
    return hit.withColumn("chr", F.lit(chrom)).select(*columns).orderBy("start", "end", "gene_id")


def transcripts(query: Query, catalog: Catalog) -> DataFrame:
    wanted = _identities(query, ("name", "id"))
    table = catalog["transcripts"]
    ids = table.where(_names_match(F.col("names"), wanted)).select("tx_id", "names")
    if "proteins" in catalog:
        ids = ids.unionByName(catalog["proteins"].where(_names_match(F.col("names"), wanted)).select(F.explode("tx_ids").alias("tx_id"), "names"))
    _must_resolve(ids, wanted, "transcript", False)
    out = table.join(ids.select("tx_id").distinct(), "tx_id", "left_semi")
    return out.select(F.col("tx_id").alias("id"), "gene_id", F.array_join("names", ",").alias("names"), "chr", "strand", "bases", "cds_bases").orderBy("id")


def _proteins(wanted: Sequence[str], catalog: Catalog) -> DataFrame:
    """Each identity's own protein, else its gene's, else its transcript's; the first that resolves."""
    p = catalog["proteins"]
    keys = F.explode(F.array(*[F.lit(w) for w in wanted])).alias("wanted")
    one = p.sparkSession.range(1).select(keys)
    match = lambda names: F.exists(names, lambda n: (F.lower(n) == F.lower("wanted")) | (strip_version(F.lower(n)) == strip_version(F.lower("wanted"))))
    steps = [p.crossJoin(F.broadcast(one)).where(match(F.col("names"))).select("wanted", "protein_id", F.lit(0).alias("step"))]
    if "genes" in catalog:
        g = catalog["genes"].crossJoin(F.broadcast(one)).where(match(F.col("names"))).select("wanted", "gene_id")
        steps.append(p.join(g, "gene_id").select("wanted", "protein_id", F.lit(1).alias("step")))
    if "transcripts" in catalog:
        t = catalog["transcripts"].crossJoin(F.broadcast(one)).where(match(F.col("names"))).select("wanted", "tx_id")
        steps.append(p.withColumn("tx_id", F.explode("tx_ids")).join(t, "tx_id").select("wanted", "protein_id", F.lit(2).alias("step")))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    best = found.groupBy("wanted").agg(F.min("step").alias("step"))
    return found.join(best, ["wanted", "step"], "left_semi").select("wanted", "protein_id").distinct()


def proteins(query: Query, catalog: Catalog) -> DataFrame:
    wanted = _identities(query, ("name", "id", "accession"))
    ids = _proteins(wanted, catalog)
    if not ids.take(1):
        raise QueryError(f"protein {wanted[0]!r} is not known")
    p = catalog["proteins"].join(ids.select("protein_id").distinct(), "protein_id", "left_semi")
    n = catalog["features"].groupBy("tx_id").agg(F.count("*").alias("n")) if "features" in catalog else None
    if n is not None:
        per = p.select("protein_id", F.explode_outer("tx_ids").alias("tx_id")).join(n, "tx_id", "left").groupBy("protein_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("feature_count"))
        p = p.join(per, "protein_id")
    else:
        p = p.withColumn("feature_count", F.lit(0).cast("long"))
    return p.select(F.col("protein_id").alias("id"), "accession", "entry", "name", "symbol", "ensp", F.array_join("tx_ids", ",").alias("tx_ids"), "feature_count").orderBy("id")


def features(query: Query, catalog: Catalog) -> DataFrame:
    """The union of labels and proteins' features, also where the text says AND."""
    table = catalog["features"]
    labels = _identities(query, ("name", "id"))
    hit = table.where(F.lower("label").isin([x.lower() for x in labels])).select("feature_id") if labels else None
    for p in query.predicates:
        if p.field == "protein":
            ids = _proteins([v for v in p.values if isinstance(v, str)], catalog)
            if p.kind == "eq" and not ids.take(1):
                raise QueryError(f"protein {p.values[0]!r} is not known")
            tx = catalog["proteins"].join(ids, "protein_id", "left_semi").select(F.explode("tx_ids").alias("tx_id")).distinct()
            own = table.join(tx, "tx_id", "left_semi").select("feature_id")
            hit = own if hit is None else hit.union(own)
    if hit is None:
        raise QueryError("feature query requires name or protein")
    shown = F.array_join(F.transform("blocks", lambda b: F.concat((b["start"] + 1).cast("string"), F.lit("-"), b["end"].cast("string"))), ",")
    out = table.join(hit.distinct(), "feature_id", "left_semi")
    return out.select(F.col("feature_id").alias("id"), "label", "kind", "description", "signature", "chr", "strand", shown.alias("blocks"), "source", "aa_start", "aa_end").orderBy("id")


def variants(query: Query, catalog: Catalog) -> DataFrame:
    """By chromosome and position; records without an alternative are passed over; clinical_effect IS [NOT] NULL is an anti or
    a semi join on (chr, pos, ref, any alternative); the first such predicate counts."""
    chrom = _equal_text(query, CHROMOSOME)
    if chrom is None:
        raise QueryError("variant query requires chromosome = text")
    start, end = _position(query)
    v = catalog["variants"].where((chromosome_key(F.col("chr")) == chromosome_key(F.lit(chrom))) & F.col("pos").between(start, end) & (F.size("alts") > 0))
    asked = next((p for p in query.predicates if p.field == "clinical_effect"), None)
    if asked is not None:
        if asked.kind not in ("null", "not_null"):
            raise QueryError("clinical_effect takes IS NULL or IS NOT NULL")
        c = catalog["clinical"].select(F.col("chr").alias("_c"), F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.col("alt").alias("_a"))
        on = (chromosome_key(F.col("chr")) == chromosome_key(F.col("_c"))) & (F.col("pos") == F.col("_p")) & (F.col("ref") == F.col("_r")) & F.array_contains("alts", F.col("_a"))
        v = v.join(c, on, "left_semi" if asked.kind == "not_null" else "left_anti")
    return v.select("chr", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref", F.array_join("alts", ",").alias("alts")).orderBy("pos", "id", "ref", "alts")


_PLANS: dict[str, Callable[[Query, Catalog], DataFrame]] = {"gene": genes, "transcript": transcripts, "protein": proteins, "feature": features, "variant": variants}


def execute(text: str, catalog: Catalog | Callable[[], Catalog]) -> DataFrame:
    """Parse, check against the schema, and only then open the catalog and plan."""
    query = validate(parse(text))
    return _PLANS[query.entity](query, catalog() if callable(catalog) else catalog)


def capabilities(catalog: Catalog) -> dict[str, tuple[str, ...]]:
    """The entities that a catalog can answer, with their fields: which payloads there are decides."""
    from siltbed.query.language import FIELDS

    need = {"gene": ("genes",), "transcript": ("transcripts",), "protein": ("proteins",), "feature": ("features",), "variant": ("variants",)}
    out = {e: FIELDS[e] for e, tables in need.items() if all(t in catalog for t in tables)}
    if "variant" in out and "clinical" not in catalog:
        out["variant"] = tuple(f for f in out["variant"] if f != "clinical_effect")
    if "feature" in out and "proteins" not in catalog:
        out["feature"] = tuple(f for f in out["feature"] if f != "protein")
    return out
