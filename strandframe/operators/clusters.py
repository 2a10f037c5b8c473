"""Variants inside clusters of aligned sequences."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from itertools import combinations, groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["cluster_no", "seq_id"]


@dataclass(frozen=True)
class ClusterOptions:
    """indel: longest gap run that counts as one; distance: of it from the ends. identity has to be exceeded."""

    samples: tuple[str, ...]
    least_samples: int = 2
    least_seqs: int = 2
    most_seqs: int = 1000
    most_out: int = 2
    identity: float = 0.95
    most_inter: int | None = None
    most_intra: int = 0
    indel: int = 1
    distance: int = 3
    reverse: bool = False


def assign_samples(msa: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """The sequences with `sample`, the one whose name starts their id. Raises where that isn't exactly one, or where the
    alignments of a cluster have several lengths."""
    fits = F.filter(F.array(*(F.lit(s) for s in samples)), lambda s: F.startswith(F.col("seq_id"), s))
    rows = msa.withColumn("__fits", fits)
    bad = rows.where(F.size("__fits") != 1).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['seq_id']} belongs to {len(bad[0]['__fits'])} samples")
    uneven = msa.groupBy("cluster_no").agg(F.count_distinct(F.length("aln")).alias("n")).where("n > 1").limit(1).collect()
    if uneven:
        raise ValueError(f"cluster {uneven[0]['cluster_no']}: alignments of several lengths")
    return rows.withColumn("sample", F.col("__fits")[0]).drop("__fits")


def sized(msa: DataFrame, how: ClusterOptions) -> DataFrame:
    """Clusters with enough samples and sequences."""
    n = msa.groupBy("cluster_no").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("s"))
    return msa.join(n.where((F.col("n").between(how.least_seqs, how.most_seqs)) & (F.col("s") >= how.least_samples)).select("cluster_no"), "cluster_no", "left_semi")


def masked(msa: DataFrame, indel: int, distance: int) -> DataFrame:
    """(cluster_no, sample, seq_id, pos, ch, masked, padding): one row per character.

    Gaps are masked, but for inner runs of at most `indel` that stay `distance` away from the trimmed ends. padding is
    the length of the inner runs that are longer. Runs are islands of consecutive gap positions.
    """
    first = F.length("aln") - F.length(F.ltrim("aln", F.lit("-")))
    last = F.length(F.rtrim("aln", F.lit("-"))) - 1
    chars = msa.select("cluster_no", "sample", "seq_id", first.alias("lo"), last.alias("hi"), F.posexplode(F.split("aln", "")).alias("pos", "ch")).where("ch <> ''")
    w = Window.partitionBy(*KEY, "gap").orderBy("pos")
    runs = chars.withColumn("gap", F.col("ch") == "-").withColumn("island", F.col("pos") - F.row_number().over(w))
    run = Window.partitionBy(*KEY, "gap", "island")
    size, a, b = F.count("*").over(run), F.min("pos").over(run), F.max("pos").over(run)
    inner = F.col("gap") & (a > F.col("lo")) & (b < F.col("hi"))
    indels = inner & (size <= indel) & (a >= F.col("lo") + distance) & (b <= F.col("hi") - distance)
    marked = runs.withColumn("masked", F.col("gap") & ~indels).withColumn("__long", (inner & (size > indel)).cast("int"))
    return marked.select("cluster_no", "sample", "seq_id", "pos", "ch", "masked", F.sum("__long").over(Window.partitionBy(*KEY)).alias("padding"))


def merge_samples(msa: DataFrame) -> DataFrame:
    """Sequences of a sample that agree wherever neither is beyond its ends become one: (cluster_no, sample, seq_id, aln,
    merged). The consensus takes the first letter that isn't a gap, in order of ids; it replaces the sequences only if it
    has no inner gap. Its id is the sample with the other parts of the ids."""
    sets = msa.groupBy("cluster_no", "sample").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq_id", "aln"))).alias("s"))
    many = sets.where("n > 1")
    lo = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit("-")))
    hi = lambda x: F.length(F.rtrim(x, F.lit("-")))
    at = lambda x, i: F.substr(x["aln"], i, F.lit(1))
    places = F.sequence(F.lit(1), F.length(F.col("s")[0]["aln"]))
    inside = lambda x, i: (i > lo(x["aln"])) & (i <= hi(x["aln"]))
    letters = lambda i: F.transform(F.filter("s", lambda x: inside(x, i)), lambda x: at(x, i))
    agree = F.forall(places, lambda i: F.size(F.array_distinct(letters(i))) <= 1)
    first = lambda i: F.coalesce(F.get(F.filter(F.transform("s", lambda x: at(x, i)), lambda c: c != "-"), F.lit(0)), F.lit("-"))
    whole = F.array_join(F.transform(places, first), "")
    name = F.concat("sample", F.array_join(F.transform("s", lambda x: F.substr(x["seq_id"], F.length("sample") + 1)), ""))
    tried = many.withColumn("agree", agree).withColumn("whole", whole).withColumn("name", name)
    inner = F.trim(F.col("whole"), F.lit("-")).contains("-")
    done = tried.where(F.col("agree") & ~inner).select("cluster_no", "sample", F.col("name").alias("seq_id"), F.col("whole").alias("aln"), F.lit(True).alias("merged"))
    rest = msa.join(done.select("cluster_no", "sample"), ["cluster_no", "sample"], "left_anti").select("cluster_no", "sample", "seq_id", "aln", F.lit(False).alias("merged"))
    return done.unionByName(rest)


def differences(chars: DataFrame, within: bool) -> DataFrame:
    """(cluster_no, id1, id2, pos, base1, base2): unmasked positions where two sequences differ, each unordered pair once;
    of one sample (`within`) or of two. Sequences with padding take no part. Characters meet per column of a cluster, and
    a cluster has at most a thousand sequences."""
    rows = chars.where("not masked and padding = 0")
    a = rows.select("cluster_no", "pos", F.col("sample").alias("s1"), F.col("seq_id").alias("id1"), F.col("ch").alias("base1"))
    b = rows.select("cluster_no", "pos", F.col("sample").alias("s2"), F.col("seq_id").alias("id2"), F.col("ch").alias("base2"))
    same = F.col("s1") == F.col("s2")
    return a.join(b, ["cluster_no", "pos"]).where((F.col("id1") < F.col("id2")) & (F.col("base1") != F.col("base2")) & (same if within else ~same)).select("cluster_no", "id1", "id2", "pos", "base1", "base2")


def variants(diffs: DataFrame) -> DataFrame:
    """Differences with neighbouring gap positions joined to one indel: (..., pos, base1, base2, length)."""
    gap = F.when(F.col("base1") == "-", F.lit(1)).when(F.col("base2") == "-", F.lit(2)).otherwise(F.lit(0))
    w = Window.partitionBy("cluster_no", "id1", "id2", "gap").orderBy("pos")
    rows = diffs.withColumn("gap", gap).withColumn("island", F.when(F.col("gap") > 0, F.col("pos") - F.row_number().over(w)).otherwise(F.col("pos")))
    one = F.min(F.struct("pos", "base1", "base2"))
    return rows.groupBy("cluster_no", "id1", "id2", "gap", "island").agg(one.alias("v"), F.count("*").alias("length")).select("cluster_no", "id1", "id2", "v.*", "length")


def pair_identities(diffs: DataFrame, chars: DataFrame) -> DataFrame:
    """(cluster_no, id1, id2, identity) of pairs with differences: the lower of both sequences' 1 - differing / unmasked."""
    size = chars.groupBy(*KEY).agg(F.count(F.when(~F.col("masked"), 1)).alias("len"))
    n = diffs.groupBy("cluster_no", "id1", "id2").agg(F.count("*").alias("weight"))
    one = lambda i: size.select("cluster_no", F.col("seq_id").alias(f"id{i}"), F.col("len").alias(f"len{i}"))
    rows = n.join(one(1), ["cluster_no", "id1"]).join(one(2), ["cluster_no", "id2"])
    return rows.select("cluster_no", "id1", "id2", (1 - F.col("weight") / F.least("len1", "len2")).alias("identity"), "len1", "len2")


def _fitting(rows: DataFrame, samples: tuple[str, ...]) -> None:
    fits = F.filter(F.array(*(F.lit(s) for s in samples)), lambda s: F.startswith(F.col("seq_id"), s))
    bad = rows.select("seq_id", fits.alias("fits")).where(F.size("fits") != 1).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['seq_id']} belongs to {len(bad[0]['fits'])} samples")


def _gaps(aln: str, how: ClusterOptions) -> tuple[set[int], bool]:
    """(masked positions, whether there is padding), as in `masked`."""
    out, padding = set(), False
    if "-" in aln:
        lo, hi = len(aln) - len(aln.lstrip("-")), len(aln.rstrip("-")) - 1
        for m in re.finditer("-+", aln):
            x, y = m.start(), m.end() - 1
            inner, size = x > lo and y < hi, y - x + 1
            if not (inner and size <= how.indel and x >= lo + how.distance and y <= hi - how.distance):
                out.update(range(x, y + 1))
            padding = padding or inner and size > how.indel
    return out, padding


def _variants(one: str, other: str, masked: set[int]) -> tuple[int, list[tuple[int, str, str]]]:
    """(how many unmasked positions differ, variants), as in `differences` and `variants`."""
    if one == other:
        return 0, []
    diffs = [(i, x, y) for i, (x, y) in enumerate(zip(one, other)) if x != y and i not in masked]
    found, last = [], (-2, 0)
    for i, x, y in diffs:
        gap = 1 if x == "-" else 2 if y == "-" else 0
        if not (gap and last == (i - 1, gap)):
            found.append((i, x, y))
        last = (i, gap)
    return len(diffs), found


def _merged(sample: str, seqs: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The sequence that replaces those of a sample, as in `merge_samples`."""
    if len(seqs) < 2:
        return None
    bounds, whole = [(len(x) - len(x.lstrip("-")), len(x.rstrip("-"))) for _, x in seqs], []
    for i in range(len(seqs[0][1])):
        if len({x[i] for (_, x), (lo, hi) in zip(seqs, bounds, strict=True) if lo <= i < hi}) > 1:
            return None
        whole.append(next((x[i] for _, x in seqs if x[i] != "-"), "-"))
    text = "".join(whole)
    return None if "-" in text.strip("-") else (sample + "".join(n[len(sample) :] for n, _ in seqs), text)


def _judged(no, seqs: list[tuple[str, str]], how: ClusterOptions) -> list[tuple] | None:
    """The rows of a cluster's table from aln_len on; None if it isn't accepted. seqs: (seq_id, aln), sorted."""
    if len({len(x) for _, x in seqs}) > 1:
        raise ValueError(f"cluster {no}: alignments of several lengths")
    if not how.least_seqs <= len(seqs) <= how.most_seqs:
        return None
    by: dict[str, list[tuple[str, str]]] = {}
    for s in seqs:
        by.setdefault(next(n for n in how.samples if s[0].startswith(n)), []).append(s)
    if len(by) < how.least_samples:
        return None
    after, merged = [], False
    for sample, own in by.items():
        made = _merged(sample, own)
        merged = merged or made is not None
        after += [(*s, sample) for s in (own if made is None else [made])]
    if len(after) > how.most_out:
        return None
    intra = 0
    for own in by.values():
        if len(own) > 1:
            laid = [(*s, mask) for s in own for mask, padding in [_gaps(s[1], how)] if not padding]
            for (id1, x, m1), (id2, y, m2) in combinations(laid, 2):
                if id1 != id2:
                    intra += len(_variants(x, y, m1 | m2)[1])
                    if intra > how.most_intra:
                        return None
    note, rows, inter = "MERGED" if merged else "HAS_INTRA" if intra else "N/A", [], 0
    laid = [(*s, mask) for s in sorted(after) for mask, padding in [_gaps(s[1], how)] if not padding]
    for (id1, x, s1, m1), (id2, y, s2, m2) in combinations(laid, 2):
        if s1 == s2 or id1 == id2:
            continue
        weight, found = _variants(x, y, m1 | m2)
        inter += len(found)
        n1, n2 = len(x) - len(m1), len(y) - len(m2)
        if found and 1 - weight / min(n1, n2) > how.identity:
            for i, b1, b2 in found:
                rows.append((len(x), id2, n2, id1, n1, i + 1, b2, b1, note, y, x) if how.reverse else (len(x), id1, n1, id2, n2, i + 1, b1, b2, note, x, y))
    return None if how.most_inter is not None and inter > how.most_inter else rows


def call_clusters(msa: DataFrame, how: ClusterOptions) -> DataFrame:
    """The 12-column table of SNPs and indels of accepted clusters: cluster_id (numbered in order of cluster_no), aln_len,
    id1, len1, id2, len2, pos (from 1), base1, base2, comments, seq1, seq2.

    Clusters are dealt out by ranges of cluster_no, once; a cluster is judged where its sequences meet, and only what
    differs leaves it. The same shuffle is read twice: for how many clusters of each range are accepted (a row each is
    broadcast), and for their rows. Alignments of several lengths raise while rows are made."""
    _fitting(msa, how.samples)
    key, arrow = msa.schema["cluster_no"].dataType.simpleString(), to_arrow_type(msa.schema["cluster_no"].dataType)
    parts = int(msa.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = msa.select("cluster_no", "seq_id", F.coalesce("aln", F.lit("")).alias("aln")).where("cluster_no is not null").repartitionByRange(parts, "cluster_no").sortWithinPartitions("cluster_no", "seq_id", "aln")

    def whole(batches):
        """(cluster_no, its sequences) of a sorted partition."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for no, own in groupby(rows, lambda r: r[0]):
            yield no, [r[1:] for r in own]

    def count(batches):
        first, n = None, 0
        for no, seqs in whole(batches):
            first = no if first is None else first
            n += _judged(no, seqs, how) is not None
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], arrow), pa.array([n])], ["first", "n"])

    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5]
    names = ["cluster_id", "aln_len", "id1", "len1", "id2", "len2", "pos", "base1", "base2", "comments", "seq1", "seq2"]

    def table(batches):
        first, n, rows = None, 0, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, arrow], strict=True)], [*names, "first"])
        for no, seqs in whole(batches):
            first = no if first is None else first
            found = _judged(no, seqs, how)
            if found is not None:
                n += 1
                rows += [(n, *r, first) for r in found]
                if len(rows) >= 10_000:
                    yield made()
                    rows = []
        if rows:
            yield made()

    counts = dealt.mapInArrow(count, f"first {key}, n long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("first", before.alias("__before"))
    text = ", ".join(f"{c} string" for c in names[7:])
    rows = dealt.mapInArrow(table, f"cluster_id long, aln_len int, id1 string, len1 long, id2 string, len2 long, pos int, {text}, first {key}")
    return rows.join(F.broadcast(starts), "first").withColumn("cluster_id", F.col("cluster_id") + F.col("__before")).select(*names)


def cluster_fasta(msa: DataFrame, aligned: bool = False, numbers: bool = True, least: int = 0) -> DataFrame:
    """FASTA lines of sequences, with gaps or without, their headers with `Cluster_n_` or without."""
    body = F.col("aln") if aligned else F.replace("aln", F.lit("-"), F.lit(""))
    head = F.concat(F.lit("Cluster_"), F.col("cluster_no").cast("string"), F.lit("_"), F.col("seq_id")) if numbers else F.col("seq_id")
    return msa.where(F.length(body) >= least).select(F.concat(F.lit(">"), head, F.lit("\n"), body).alias("value"))
