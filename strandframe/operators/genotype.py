"""SNP genotyping by k-mers: calls, false-positive and threshold filters, report formats, distances."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandframe.functions import coded as C
from strandframe.functions import sequence as S
from strandframe.operators.kmers import capped
from strandframe.operators.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SNP = ["cluster_id", "pos0"]
EVIDENCE = [*SNP, "sample", "freq1", "freq2", "cov1", "cov2", "links1", "links2", "base1", "base2"]


@dataclass(frozen=True)
class CallOptions:
    """least_sum of both medians, least_minor of each for two alleles, least_coverage of an allele's windows,
    most_error: coverage up to which an allele counts as error."""

    k: int
    least_sum: float = 3
    least_minor: float = 3
    least_coverage: float = 0.9
    most_error: float = 0.05

    @staticmethod
    def filtering(k: int) -> CallOptions:
        """Thresholds for sets that are only used to find false positives."""
        return CallOptions(k, 2, 1, 0.75, 0.05)


def check_parents(snps: DataFrame) -> None:
    """Raise where the parents have the same base at the SNP."""
    same = snps.where(F.expr("substr(seq1, pos0 + 1, 1) = substr(seq2, pos0 + 1, 1)")).limit(1).collect()
    if same:
        raise ValueError(f"parents don't differ at {same[0]['cluster_id']}:{same[0]['pos0'] + 1}")


def distinct_snps(table: DataFrame, order: str) -> DataFrame:
    """Of rows with one cluster and position the first by `order`."""
    w = Window.partitionBy(*SNP).orderBy(order)
    return table.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def snp_kmers(snps: DataFrame, k: int) -> DataFrame:
    """(cluster_id, pos0, parent, links, kmer): windows over the SNP in each parent without gaps."""
    parent = lambda n: F.struct(F.lit(n).alias("parent"), F.col(f"seq{n}").alias("aln"))
    each = snps.select(*SNP, F.explode(F.array(parent(1), parent(2))).alias("p")).select(*SNP, "p.parent", "p.aln")
    each = each.withColumn("site", S.unpadded_position(F.col("aln"), F.col("pos0"))).withColumn("seq", S.ungap(F.col("aln")))
    first = F.greatest(F.lit(0), F.col("site") - (k - 1))
    last = F.least(F.length("seq") - k, F.col("site"))
    each = each.withColumn("links", F.greatest(last - first + 1, F.lit(0)))
    windows = F.transform(F.sequence(first, last), lambda i: S.canonical(F.substr(F.col("seq"), i + 1, F.lit(k))))
    return each.where("links > 0").select(*SNP, "parent", "links", F.explode(windows).alias("kmer"))


def call_snps(snps: DataFrame, samples: DataFrame, how: CallOptions) -> DataFrame:
    """One row per SNP and sample that has one of its k-mers: freq1, freq2 (medians), cov1, cov2, links1, links2,
    allele1, allele2. SNPs and samples that don't meet have no row, which is no call. SNPs have to be distinct. Up to
    k = 11 windows are looked up in a table of frequencies; longer ones, and SNPs of which a parent has other letters
    than A, C, G, T and gaps, join them."""
    if how.k > C.TABLE_K:
        return _judged(_joined_snps(snps, samples, how), how)
    plain = C.plain(S.ungap(F.concat("seq1", "seq2")))
    odd, blocks = snps.where(~plain), cut(C.packed(samples, how.k))
    few = C.blank(odd)
    parts = [_looked_up_snps(snps if few else snps.where(plain), some, table, samples, how.k) for some, table in C.tables(snps.sparkSession, blocks, how.k)]
    if not parts or not few:
        parts.append(_joined_snps(odd, samples, how))
    return _judged(reduce(DataFrame.unionByName, parts), how)


def _looked_up_snps(snps: DataFrame, some: list, table, samples: DataFrame, k: int) -> DataFrame:
    """The evidence of SNPs in some samples, whose frequencies are in a table."""
    kind = to_arrow_type(samples.schema["sample"].dataType)

    def make(b):
        rows, m = b.num_rows, len(some)
        freq, cov, links = np.zeros((2, rows, m)), np.zeros((2, rows, m), np.int32), np.zeros((2, rows), np.int32)
        for p in (0, 1):
            x, ends = C.letters(b.column(4 + p))
            site, sizes, codes = b.column(6 + p).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends), C.rolled(x, k)
            first = np.maximum(site - (k - 1), 0)
            links[p] = width = np.maximum(np.minimum(sizes - k, site) - first + 1, 0)
            for w in np.unique(width[width > 0]):
                at = np.flatnonzero(width == w)
                own = codes[(ends[:-1] + first)[at][:, None] + np.arange(w)]
                for j in range(m):
                    cov[p, at, j], freq[p, at, j] = C.middle(table.value[j][own])
        row, sample = np.nonzero(cov.sum(axis=0) > 0)
        take = pa.array(row)
        numbers = [*(v[p][row, sample] for v in (freq, cov) for p in (0, 1)), *(links[p][row] for p in (0, 1))]
        names = pa.array(some, kind).take(pa.array(sample))
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), names, *map(pa.array, numbers), b.column(2).take(take), b.column(3).take(take)], EVIDENCE)

    sites = (S.unpadded_position(F.col(f"seq{n}"), F.col("pos0")).cast("long").alias(f"site{n}") for n in (1, 2))
    rows = snps.select(*SNP, *_bases(), *(S.ungap(F.col(f"seq{n}")).alias(f"seq{n}") for n in (1, 2)), *sites)
    kinds = [*(snps.schema[c].dataType.simpleString() for c in SNP), samples.schema["sample"].dataType.simpleString(), "double", "double", *("int",) * 4, "string", "string"]
    return C.in_batches(rows, make, ", ".join(f"{c} {t}" for c, t in zip(EVIDENCE, kinds, strict=True)))


def _bases() -> list[Column]:
    return [F.expr(f"substr(seq{n}, pos0 + 1, 1)").alias(f"base{n}") for n in (1, 2)]


def _joined_snps(snps: DataFrame, samples: DataFrame, how: CallOptions) -> DataFrame:
    """The evidence of SNPs by a join of windows."""
    windows = snp_kmers(snps, how.k)
    links = windows.groupBy(*SNP).agg(*(F.coalesce(F.max(F.when(F.col("parent") == n, F.col("links"))), F.lit(0)).alias(f"links{n}") for n in (1, 2)))
    hits = windows.join(capped(samples).where("freq > 0"), "kmer")
    own = lambda n, c: F.when(F.col("parent") == n, c)
    seen = hits.groupBy(*SNP, "sample").agg(
        *(S.median0(own(n, F.col("freq"))).alias(f"freq{n}") for n in (1, 2)), *(F.count(own(n, F.lit(1))).cast("int").alias(f"cov{n}") for n in (1, 2))
    )
    return seen.join(links, SNP).join(snps.select(*SNP, *_bases()), SNP).select(*EVIDENCE)


def _judged(rows: DataFrame, how: CallOptions) -> DataFrame:
    ratio = {n: F.when(F.col(f"links{n}") > 0, F.col(f"cov{n}") / F.col(f"links{n}")).otherwise(F.lit(0.0)) for n in (1, 2)}
    full = {n: ratio[n] >= how.least_coverage for n in (1, 2)}
    error = {n: ratio[n] <= how.most_error for n in (1, 2)}
    f1, f2 = F.col("freq1"), F.col("freq2")
    seen_enough = (f1 + f2 >= how.least_sum) & (full[1] | full[2])
    kept = {n: full[n] & ~error[n] for n in (1, 2)}  # an allele that is error has no coverage left
    only2, only1 = seen_enough & (f1 == 0) & kept[2], seen_enough & ~((f1 == 0) & kept[2]) & (f2 == 0) & kept[1]
    both = seen_enough & ~only1 & ~only2 & (f1 >= how.least_minor) & (f2 >= how.least_minor) & kept[1] & kept[2]
    return rows.select(
        *SNP, "sample", "freq1", "freq2", "cov1", "cov2", "links1", "links2", "base1", "base2",
        F.when(only1 | both, F.col("base1")).when(only2, F.col("base2")).alias("allele1"), F.when(both, F.col("base2")).alias("allele2"),
    )


def false_positives(snps: DataFrame, calls: DataFrame, order: str = "line") -> DataFrame:
    """SNPs that stay: those with two alleles in a filtering sample go, and neighbours in the same cluster fall with
    them, all the following ones and the one before.

    `order` is the row number of the SNP table; neighbours are consecutive rows of one cluster.
    """
    hit = calls.where("allele2 is not null").select(*SNP).distinct().withColumn("__bad", F.lit(1))
    marked = snps.join(hit, SNP, "left").withColumn("__bad", F.coalesce("__bad", F.lit(0)))
    # a cluster's rows are consecutive: the table is sorted by cluster when it is written
    w = Window.partitionBy("cluster_id").orderBy(order)
    bad = F.max("__bad").over(w.rowsBetween(Window.unboundedPreceding, 1))
    return marked.withColumn("__gone", bad).where("__gone = 0").drop("__bad", "__gone")


def threshold_filter(
    calls: DataFrame, least_called: int = 0, most_called: int | None = None, least_hom: int = 0, most_hom: int | None = None, least_het: int = 0, most_het: int | None = None, both_parents: bool = True
) -> DataFrame:
    """(cluster_id, pos0) of SNPs whose numbers of calls are in range and, with `both_parents`, that have an AA and a BB call."""
    called = F.col("allele1").isNotNull() | F.col("allele2").isNotNull()
    het = F.col("allele1").isNotNull() & F.col("allele2").isNotNull()
    code = S.parents_text(F.col("allele1"), F.col("allele2"), F.col("base1"), F.col("base2"))
    n = calls.groupBy(*SNP).agg(
        F.count(F.when(called & ~het, 1)).alias("hom"), F.count(F.when(het, 1)).alias("het"), F.count(F.when(code == "AA", 1)).alias("aa"), F.count(F.when(code == "BB", 1)).alias("bb")
    )
    fits = (F.col("hom") >= least_hom) & (F.col("het") >= least_het) & (F.col("hom") + F.col("het") >= least_called)
    for most, c in ((most_hom, F.col("hom")), (most_het, F.col("het")), (most_called, F.col("hom") + F.col("het"))):
        fits = fits if most is None else fits & (c <= most)
    return n.where(fits & (F.col("aa") > 0) & (F.col("bb") > 0) if both_parents else fits).select(*SNP, "hom", "het", "aa", "bb")


def _text(freq: Column) -> Column:
    return freq.cast("string")


def reports(calls: DataFrame) -> DataFrame:
    """Every text format of a call, in long form: site (`cluster:position`), sample, slash, ab, iupac, cov, freq,
    evidence, call_with_evidence. iupac is null at indels."""
    a, b = F.col("allele1"), F.col("allele2")
    indel = (F.col("base1") == "-") | (F.col("base2") == "-")
    evidence = S.evidence_text(F.col("cov1"), F.col("freq1"), F.col("cov2"), F.col("freq2"))
    return calls.select(
        F.concat_ws(":", F.col("cluster_id").cast("string"), (F.col("pos0") + 1).cast("string")).alias("site"), "sample", S.alleles_text(a, b).alias("slash"),
        S.parents_text(a, b, F.col("base1"), F.col("base2")).alias("ab"), F.when(~indel, S.pair_code(a, b)).alias("iupac"), S.slash(F.col("cov1"), F.col("cov2")).alias("cov"),
        S.slash(F.col("freq1"), F.col("freq2")).alias("freq"), evidence.alias("evidence"), F.concat_ws(" ", S.alleles_text(a, b), evidence).alias("call_with_evidence"),
    )


def report_wide(long: DataFrame, what: str, samples: list) -> DataFrame:
    return long.groupBy("site").pivot("sample", samples).agg(F.first(what))


def parent_fasta(snps: DataFrame) -> DataFrame:
    """FASTA lines of both parents without gaps; the header has the position without gaps, from 1."""
    one = lambda n: F.concat(F.lit(">"), F.col(f"id{n}"), F.lit(" "), F.col("cluster_id").cast("string"), F.lit(":"), (S.unpadded_position(F.col(f"seq{n}"), F.col("pos0")) + 1).cast("string"), F.lit("\n"), S.ungap(F.col(f"seq{n}")))
    return snps.select(F.explode(F.array(one(1), one(2))).alias("value"))


def distances(calls: DataFrame) -> DataFrame:
    """(sample1, sample2, called, distance) of all ordered pairs: 1 - equal calls / SNPs where both are called; null
    where there are none, 0 on the diagonal. Samples meet per SNP, so a task holds the samples of a SNP."""
    call = S.alleles_text(F.col("allele1"), F.col("allele2"))
    called = F.col("allele1").isNotNull() | F.col("allele2").isNotNull()
    sets = calls.groupBy(*SNP).agg(F.collect_list(F.struct("sample", F.when(called, call).alias("call"))).alias("s"))
    each = sets.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a.sample <= b.sample")
    met = F.col("a.call").isNotNull() & F.col("b.call").isNotNull()
    # the calls are read once; what is left is a row for each pair of samples, the diagonal names them
    grouped = cut(each.groupBy(F.col("a.sample").alias("sample1"), F.col("b.sample").alias("sample2")).agg(F.count(F.when(met, 1)).alias("called"), F.sum((F.col("a.call") == F.col("b.call")).cast("int")).alias("equal")))
    half = grouped.where("sample1 < sample2 and called > 0").select("sample1", "sample2", "called", (1 - F.col("equal") / F.col("called")).alias("distance"))
    names = F.broadcast(grouped.where("sample1 = sample2").select(F.col("sample1").alias("sample")))  # one per input file
    grid = names.withColumnRenamed("sample", "sample1").crossJoin(names.withColumnRenamed("sample", "sample2"))
    both = half.unionByName(half.select(F.col("sample2").alias("sample1"), F.col("sample1").alias("sample2"), "called", "distance"))
    joined = grid.join(both, ["sample1", "sample2"], "left")
    same = F.col("sample1") == F.col("sample2")
    return joined.select("sample1", "sample2", F.coalesce("called", F.lit(0)).alias("called"), F.when(same, F.lit(0.0)).otherwise(F.col("distance")).alias("distance"))


def nexus(rows: list) -> str:
    """NEXUS text of collected `distances` (as many rows as pairs of samples)."""
    names = sorted({str(r["sample1"]) for r in rows})
    value = {(str(r["sample1"]), str(r["sample2"])): "NaN" if r["distance"] is None else f"{r['distance']:.6f}" for r in rows}
    taxa = "".join(f"    [{i}] '{n}'\n" for i, n in enumerate(names, 1))
    body = "".join(f"    '{a}' " + " ".join(value.get((a, b), "NaN") for b in names) + "\n" for a in names)
    return (
        f"#NEXUS\nBEGIN TAXA;\n  DIMENSIONS ntax={len(names)};\n  TAXLABELS\n{taxa}  ;\nEND;\n"
        f"BEGIN DISTANCES;\n  DIMENSIONS ntax={len(names)};\n  FORMAT labels=left diagonal triangle=both;\n  MATRIX\n{body}  ;\nEND;\n"
    )


# -- seeds with four alleles -----------------------------------------------------------------------


def seed_calls(seeds: DataFrame, samples: DataFrame, k: int, seed_id: str = "seed_id", seq: str = "seq") -> DataFrame:
    """Each seed with each base at position k - 1: covered windows and median per base, and the code of the bases that
    any sample k-mer covers; `.` for none. One row per seed and sample, arrays in the order A, C, G, T. `seed_id` has to be
    unique. Up to k = 11 windows are looked up in a table of frequencies; longer ones, and seeds with other letters than
    A, C, G and T beside the place, join them."""
    if k > C.TABLE_K:
        return _joined_seeds(seeds, samples, k, seed_id, seq)
    plain = C.plain(F.concat(F.substring(seq, 1, k - 1), F.expr(f"substring({seq}, {k + 1})")))
    odd, blocks = seeds.where(~plain), cut(C.packed(samples, k))
    few = C.blank(odd)
    parts = [_looked_up_seeds(seeds if few else seeds.where(plain), some, table, samples, k, seed_id, seq) for some, table in C.tables(seeds.sparkSession, blocks, k)]
    if not parts or not few:
        parts.append(_joined_seeds(odd, samples, k, seed_id, seq))
    return reduce(DataFrame.unionByName, parts)


def _looked_up_seeds(seeds: DataFrame, some: list, table, samples: DataFrame, k: int, seed_id: str, seq: str) -> DataFrame:
    """`seed_calls` in some samples, whose frequencies are in a table."""
    kind = to_arrow_type(samples.schema["sample"].dataType)
    codes = [S.IUPAC.get("".join(b for i, b in enumerate("ACGT") if mask >> i & 1), ".") for mask in range(16)]

    def make(b):
        rows, m = b.num_rows, len(some)
        n, med = np.zeros((rows, m, 4), np.int64), np.zeros((rows, m, 4))
        x, ends = C.letters(b.column(1))
        sizes = np.diff(ends)
        for size in np.unique(sizes[sizes >= k]):
            at = np.flatnonzero(sizes == size)
            width = min(size - k, k - 1) + 1
            own = np.repeat(x[ends[at][:, None] + np.arange(size)][:, None, :], 4, axis=1)
            own[:, :, k - 1] = np.arange(4)
            own = C.rolled(own.ravel(), k)[(np.arange(4 * len(at)) * size)[:, None] + np.arange(width)]
            for j in range(m):
                found, middle = C.middle(table.value[j][own])
                n[at, j], med[at, j] = found.reshape(-1, 4), middle.reshape(-1, 4)
        mask = ((n > 0) << np.arange(4)).sum(axis=2).ravel()
        take, ends = pa.array(np.repeat(np.arange(rows), m)), pa.array(np.arange(rows * m + 1, dtype=np.int32) * 4)
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (n, med)]
        names = pa.array(some, kind).take(pa.array(np.tile(np.arange(m), rows)))
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), names, b.column(2).take(take), *lists, pa.array(codes).take(pa.array(mask))], [seed_id, "sample", "ref_base", "covered", "medians", "call"])

    # a seed that ends before the place gets its variants by appending, as the place is the next one
    laid = F.concat(F.substring(seq, 1, k - 1), F.when(F.length(seq) >= k - 1, F.lit("A")).otherwise(F.lit("")), F.expr(f"substring({seq}, {k + 1})"))
    rows = seeds.select(seed_id, laid.alias("laid"), F.substring(seq, k, 1).alias("ref_base"))
    return C.in_batches(rows, make, f"`{seed_id}` {seeds.schema[seed_id].dataType.simpleString()}, sample {samples.schema['sample'].dataType.simpleString()}, ref_base string, covered array<long>, medians array<double>, call string")


def _joined_seeds(seeds: DataFrame, samples: DataFrame, k: int, seed_id: str, seq: str) -> DataFrame:
    """`seed_calls` by a join of windows."""
    bases = F.explode(F.array(*(F.lit(b) for b in "ACGT"))).alias("base")
    variants = seeds.select(seed_id, seq, bases).withColumn("var", F.concat(F.substring(seq, 1, k - 1), F.col("base"), F.expr(f"substring({seq}, {k + 1})")))
    last = F.least(F.length("var") - k, F.lit(k - 1))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: S.canonical(F.substr(F.col("var"), i + 1, F.lit(k))))
    each = variants.where(F.length("var") >= k).select(seed_id, "base", F.explode(windows).alias("kmer"))
    hits = each.join(capped(samples).where("freq > 0"), "kmer").groupBy(seed_id, "sample", "base").agg(F.count("*").alias("n"), S.median0(F.col("freq")).alias("med"))
    pick = lambda c, b, zero: F.coalesce(F.max(F.when(F.col("base") == b, F.col(c))), zero)
    seen = hits.groupBy(seed_id, "sample").agg(
        F.array(*(pick("n", b, F.lit(0)) for b in "ACGT")).alias("covered"), F.array(*(pick("med", b, F.lit(0.0)) for b in "ACGT")).alias("medians"), F.array_sort(F.collect_set("base")).alias("found")
    )
    grid = seeds.select(seed_id, seq).crossJoin(F.broadcast(samples.select("sample").distinct()))
    joined = grid.join(seen, [seed_id, "sample"], "left")
    zeros, nothing = F.array(*(F.lit(0).cast("long"),) * 4), F.array(*(F.lit(0.0),) * 4)
    return joined.select(
        seed_id, "sample", F.substring(seq, k, 1).alias("ref_base"), F.coalesce("covered", zeros).alias("covered"), F.coalesce("medians", nothing).alias("medians"), F.coalesce(S.iupac(F.col("found")), F.lit(".")).alias("call")
    )
