"""Registered queries of the sequence operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import assembly, clusters, demultiplex, domains, expression, frequency, genotype, kmers, match, orf, pileup
from strandframe.plans import views as V
from strandframe.plans.views import Q_DEPTHS, Q_LONG, Q_PARTS, Q_READS, Q_SAMPLE_SEQS, Q_SNPS, q_canonical, q_dna, q_rc, q_windows
from strandframe.sources.writers import length_histogram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- functions and counts ---------------------------------------------------------------------------


@query(f"select read_id, {q_rc('seq')} as rc, {q_canonical('seq')} as canon, seq <= {q_rc('seq')} as is_canon from {Q_READS}")
def sequence_functions(spark, d):
    s = F.col("seq")
    return V.reads(spark, d).select("read_id", S.reverse_complement(s).alias("rc"), S.canonical(s).alias("canon"), S.is_canonical(s).alias("is_canon"))


_AMINO = f"substr('{S.AMINO_ACIDS}', 16 * (strpos('TCAG', substr(c, 1, 1)) - 1) + 4 * (strpos('TCAG', substr(c, 2, 1)) - 1) + strpos('TCAG', substr(c, 3, 1)), 1)"


@query(
    f"""with s as {Q_LONG}, c as (select seq_id, i, substr(seq, 3 * i + 1, 3) as c from (select seq_id, seq, unnest(range(0, length(seq) // 3)) as i from s))
    select s.seq_id, coalesce(p, '') as protein from s left join (select seq_id, string_agg({_AMINO}, '' order by i) as p from c group by seq_id) using (seq_id)"""
)
def translate(spark, d):
    return V.long_sequences(spark, d).select("seq_id", S.translate(F.col("seq")).alias("protein"))


_SAMPLES = f"(select sample, kmer, cast(least(sum(weight), 32767) as int) as freq from {q_windows(Q_SAMPLE_SEQS, 'sample, weight', 'seq', 11)} group by sample, kmer)"


def _samples(spark, d):
    return kmers.count_kmers(V.sample_sequences(spark, d), 11, ["sample"], weight="weight")


@query(f"select * from {_SAMPLES}")
def count_kmers(spark, d):
    return _samples(spark, d)


@query(f"select length(seq) as length, count(*) as n from {Q_LONG} group by 1")
def length_counts(spark, d):
    return length_histogram(V.long_sequences(spark, d))


# -- matching ---------------------------------------------------------------------------------------

_M, _K = 13, 9  # of matching and of placing
_SET = f"(select distinct kmer from {q_windows(Q_PARTS, '', 'seq', _M)})"
_PLACED = f"(select distinct kmer from {q_windows(Q_PARTS, '', 'seq', _K)})"
_HITS = f"(select read_id, count(*) as hits from {q_windows(Q_READS, 'read_id', 'seq', _M)} where kmer in (select kmer from {_SET}) group by read_id)"


def _set(spark, d, k=_M):
    """The reference set is of all parts."""
    return kmers.reference_set(V.part_sequences(spark, d), k)


def _windows(spark, d):
    """The same with repeats, which matching doesn't mind."""
    return kmers.reference_windows(V.part_sequences(spark, d), _M)


@query(f"select read_id from {Q_READS} where read_id in (select read_id from {_HITS})")
def kmatch(spark, d):
    return match.match_reads(V.reads(spark, d), _windows(spark, d), match.MatchOptions(_M)).select("read_id")


@query(f"select read_id from {Q_READS} where read_id not in (select read_id from {_HITS})")
def kmatch_invert(spark, d):
    return match.match_reads(V.reads(spark, d), _windows(spark, d), match.MatchOptions(_M, invert=True)).select("read_id")


@query(f"select read_id from {_HITS} where hits >= 3 and hits / 56.0 >= 0.06")
def kmatch_share(spark, d):
    return match.match_reads(V.reads(spark, d), _windows(spark, d), match.MatchOptions(_M, 3, 0.06)).select("read_id")


@query(f"select read_id, coalesce(hits, 0) as hits from {Q_READS} left join {_HITS} using (read_id)")
def kmatch_counts(spark, d):
    return match.match_counts(V.reads(spark, d), _windows(spark, d), _M)


_MATES = f"(select o_orderkey as read_id, unnest([{q_dna('o_orderkey')}, {q_rc(q_dna('o_orderkey + 1'))}]) as seq from orders)"


@query(f"select distinct read_id from {q_windows(_MATES, 'read_id', 'seq', _M)} where kmer in (select kmer from {_SET}) group by read_id having count(*) >= 2")
def kmatch_paired(spark, d):
    return match.match_reads(V.paired_reads(spark, d), _windows(spark, d), match.MatchOptions(_M, 2), mate="seq2").select("read_id")


@query(f"select kmer from {_SET}")
def kmatch_dump(spark, d):
    return _set(spark, d).select("kmer")


def _lines(spark, d):
    key = F.col("o_orderkey").cast("string")
    return V.table(spark, d, "orders").select(F.concat(F.lit("@"), key, F.lit("/2\t"), V.dna(F.col("o_orderkey"))).alias("line"))


def _ids(spark, d):
    return match.clean_ids(V.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("@"), F.col("l_orderkey").cast("string"), F.lit("/1")).alias("value")))


_LINE = f"select '@' || cast(o_orderkey as varchar) || '/2' || chr(9) || {q_dna('o_orderkey')} as line from orders where o_orderkey"


@query(f"{_LINE} in (select l_orderkey from lineitem where l_returnflag = 'R')")
def idmatch(spark, d):
    return match.match_ids(_lines(spark, d), _ids(spark, d))


@query(f"{_LINE} not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def idmatch_invert(spark, d):
    return match.match_ids(_lines(spark, d), _ids(spark, d), invert=True)


@query(f"select seen as kmer, seq_id, pos + 1 as start, pos + {_K} as \"end\" from {q_windows(Q_LONG, 'seq_id', 'seq', _K)} where kmer in (select kmer from {_PLACED})")
def kmerlocate(spark, d):
    return match.locate_kmers(V.long_sequences(spark, d), _set(spark, d, _K), _K)


@query(f"select seq_id, count(*) as placed from {q_windows(Q_LONG, 'seq_id', 'seq', _K)} where kmer in (select kmer from {_PLACED}) group by seq_id")
def kmerlocate_totals(spark, d):
    return match.located_totals(match.locate_kmers(V.long_sequences(spark, d), _set(spark, d, _K), _K))


# -- frequencies ------------------------------------------------------------------------------------

_COVERAGE = f"""(with w as {q_windows(Q_READS, 'read_id', 'seq', 11)}, u as (select read_id, count(distinct kmer) as unique_kmers from w group by read_id),
  h as (select read_id, sample, median(freq) as med, count(*) as n from w join {_SAMPLES} using (kmer) group by read_id, sample)
  select u.read_id as seq_id, s.sample, coalesce(med, 0.0) as median_freq, coalesce(n, 0) as num_kmers, coalesce(n, 0) / unique_kmers as kmer_ratio
  from u cross join (select distinct l_linenumber as sample from lineitem) s left join h on h.read_id = u.read_id and h.sample = s.sample)"""


def _coverage(spark, d):
    return frequency.coverage(V.reads(spark, d).withColumnRenamed("read_id", "seq_id"), _samples(spark, d), 11)


@query(f"select * from {_COVERAGE}")
def freqmers(spark, d):
    return _coverage(spark, d)


_WIDE = ", ".join(f'max(case when sample = {s} then {c} end) as "{s}_{c}"' for s in range(1, 8) for c in ("median_freq", "num_kmers", "kmer_ratio"))


@query(f"select seq_id, {_WIDE} from {_COVERAGE} group by seq_id")
def freqmers_wide(spark, d):
    return frequency.coverage_wide(_coverage(spark, d), list(range(1, 8)))


# -- genotyping -------------------------------------------------------------------------------------


def _alleles(spark, d):
    """Each line's sample has parent 1, parent 2 or both, by order key and line number."""
    lines = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("sample"), F.col("l_quantity").cast("long").alias("weight"))
    kind = (F.col("line") + F.col("sample")) % 3
    both = F.array_compact(F.array(F.when(kind != 1, F.col("seq1")), F.when(kind != 0, F.col("seq2"))))
    return lines.join(V.snps(spark, d), "line").select("sample", "weight", F.explode(both).alias("seq"))


_ALLELES = f"""(select sample, weight, seq from (select l_linenumber as sample, cast(l_quantity as bigint) as weight,
  unnest(case (line + l_linenumber) % 3 when 0 then [seq1] when 1 then [seq2] else [seq1, seq2] end) as seq from lineitem join {Q_SNPS} on l_orderkey = line))"""
_GENO = f"(select sample, kmer, cast(least(sum(weight), 32767) as int) as freq from {q_windows(_ALLELES, 'sample, weight', 'seq', 11)} group by sample, kmer)"
_CALLS = f"""(with p as (select cluster_id, pos0, 1 as parent, seq1 as seq from {Q_SNPS} union all select cluster_id, pos0, 2, seq2 from {Q_SNPS}),
  one as (select cluster_id, pos0, min(line) as line from {Q_SNPS} group by all),
  w as (select cluster_id, pos0, parent, {q_canonical('substr(seq, i + 1, 11)')} as kmer from
    (select *, unnest(range(greatest(0, pos0 - 10), least(length(seq) - 11, pos0) + 1)) as i from p)),
  l as (select cluster_id, pos0, count(*) filter (parent = 1) as links1, count(*) filter (parent = 2) as links2 from w group by all),
  h as (select cluster_id, pos0, sample, coalesce(median(freq) filter (parent = 1), 0.0) as freq1, coalesce(median(freq) filter (parent = 2), 0.0) as freq2,
    count(*) filter (parent = 1) as cov1, count(*) filter (parent = 2) as cov2 from w join {_GENO} using (kmer) group by all),
  b as (select cluster_id, pos0, substr(seq1, pos0 + 1, 1) as base1, substr(seq2, pos0 + 1, 1) as base2 from {Q_SNPS}),
  r as (select *, cov1 / links1 as r1, cov2 / links2 as r2 from h join l using (cluster_id, pos0) join b using (cluster_id, pos0)),
  k as (select *, case when freq1 + freq2 < 3 or (r1 < 0.9 and r2 < 0.9) then 'none' when freq1 = 0 and r2 >= 0.9 then 'two' when freq2 = 0 and r1 >= 0.9 then 'one'
    when freq1 >= 3 and freq2 >= 3 and r1 >= 0.9 and r2 >= 0.9 then 'both' else 'none' end as kind from r)
  select cluster_id, pos0, sample, freq1, freq2, cov1, cov2, links1, links2, base1, base2,
    case kind when 'one' then base1 when 'both' then base1 when 'two' then base2 end as allele1, case kind when 'both' then base2 end as allele2 from k)"""


def _snps(spark, d):
    return genotype.distinct_snps(V.snps(spark, d), "line")


def _calls(spark, d):
    return genotype.call_snps(_snps(spark, d), kmers.count_kmers(_alleles(spark, d), 11, ["sample"], weight="weight"), genotype.CallOptions(11))


# Two SNPs of one view cluster at one position keep the first row; the SQL does the same.
_CALLS = _CALLS.replace(f"from {Q_SNPS}", "from snp").replace("(with p as", f"(with snp as (select * exclude (n) from (select *, row_number() over (partition by cluster_id, pos0 order by line) as n from {Q_SNPS}) where n = 1), p as", 1)


@query(f"select * from {_CALLS}")
def snpmers_calls(spark, d):
    return _calls(spark, d)


@query(
    f"""with c as {_CALLS}, s as (select cluster_id, pos0, min(line) as line from {Q_SNPS} group by all),
    m as (select s.*, coalesce(b, 0) as bad from s left join (select distinct cluster_id, pos0, 1 as b from c where sample = 1 and allele2 is not null) using (cluster_id, pos0))
    select cluster_id, pos0 from (select *, max(bad) over (partition by cluster_id order by line rows between unbounded preceding and 1 following) as gone from m) where gone = 0"""
)
def snpmers_false_positives(spark, d):
    return genotype.false_positives(_snps(spark, d), _calls(spark, d).where("sample = 1")).select("cluster_id", "pos0")


@query(
    f"""select cluster_id, pos0, count(*) filter (allele1 is not null and allele2 is null) as hom, count(*) filter (allele2 is not null) as het,
    count(*) filter (allele2 is null and allele1 = base1) as aa, count(*) filter (allele2 is null and allele1 = base2) as bb from {_CALLS} group by all having aa > 0 and bb > 0 and hom >= 2"""
)
def snpmers_thresholds(spark, d):
    return genotype.threshold_filter(_calls(spark, d), least_hom=2)


@query(
    f"""with c as (select cluster_id, pos0, sample, concat_ws('/', allele1, allele2) as call from {_CALLS} where allele1 is not null),
    n as (select distinct l_linenumber as sample from lineitem),
    p as (select a.sample as sample1, b.sample as sample2, count(*) as called, 1 - sum(cast(a.call = b.call as int)) / count(*) as distance
      from c a join c b on a.cluster_id = b.cluster_id and a.pos0 = b.pos0 and a.sample <> b.sample group by all)
    select x.sample as sample1, y.sample as sample2, coalesce(called, 0) as called, case when x.sample = y.sample then 0.0 else distance end as distance
    from n x cross join n y left join p on p.sample1 = x.sample and p.sample2 = y.sample"""
)
def snpmers_distances(spark, d):
    return genotype.distances(_calls(spark, d))


_PAIR = "case least(allele1, allele2) || greatest(allele1, allele2) when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' end"


@query(
    f"""select cast(cluster_id as varchar) || ':' || cast(pos0 + 1 as varchar) as site, sample, case when allele1 is null then 'N' else concat_ws('/', allele1, allele2) end as slash,
    case when allele1 is null then 'NN' when allele2 is not null then 'AB' when allele1 = base1 then 'AA' else 'BB' end as ab,
    case when allele1 is null then 'N' when allele2 is null then allele1 else {_PAIR} end as iupac, cast(cov1 as varchar) || '/' || cast(cov2 as varchar) as cov from {_CALLS}"""
)
def snpmers_reports(spark, d):
    return genotype.reports(_calls(spark, d)).select("site", "sample", "slash", "ab", "iupac", "cov")


_SEEDS = f"(select o_orderkey as seed_id, substr({q_dna('o_orderkey')}, 1, 21) as seq from orders)"
_VARIANTS = f"(select seed_id, base, substr(seq, 1, 10) || base || substr(seq, 12) as var from {_SEEDS}, (select unnest(['A', 'C', 'G', 'T']) as base))"


@query(
    f"""with h as (select seed_id, sample, base, count(*) as n from {q_windows(_VARIANTS, 'seed_id, base', 'var', 11)} join {_SAMPLES} using (kmer) group by all),
    g as (select seed_id, sample, string_agg(base, '' order by base) as found, coalesce(sum(n) filter (base = 'A'), 0) as cov_a, coalesce(sum(n) filter (base = 'T'), 0) as cov_t from h group by all)
    select s.seed_id, x.sample, substr(seq, 11, 1) as ref_base, cast(coalesce(cov_a, 0) as bigint) as cov_a, cast(coalesce(cov_t, 0) as bigint) as cov_t,
    coalesce(case found {' '.join(f"when '{k}' then '{v}'" for k, v in S.IUPAC.items())} end, '.') as call
    from {_SEEDS} s cross join (select distinct l_linenumber as sample from lineitem) x left join g on g.seed_id = s.seed_id and g.sample = x.sample"""
)
def seedmers(spark, d):
    seeds = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("seed_id"), F.substring(V.dna(F.col("o_orderkey")), 1, 21).alias("seq"))
    rows = genotype.seed_calls(seeds, _samples(spark, d), 11)
    return rows.select("seed_id", "sample", "ref_base", F.col("covered")[0].alias("cov_a"), F.col("covered")[3].alias("cov_t"), "call")


# -- pileup -----------------------------------------------------------------------------------------


@query(f"select a.sample as sample1, b.sample as sample2, count(*) as loci from {Q_DEPTHS} a join {Q_DEPTHS} b using (ref, pos) where a.depth between 2 and 1000 and b.depth between 2 and 1000 group by all")
def pileup_overlaps(spark, d):
    return pileup.overlaps(V.depths(spark, d))


@query(
    f"""select least_depth, samples, count(*) as loci from (select ref, pos, least_depth, count(*) as samples from {Q_DEPTHS},
    (select unnest(range(2, 21)) as least_depth) where depth >= least_depth group by all) group by all"""
)
def pileup_samples_at_depth(spark, d):
    return pileup.samples_at_depth(V.depths(spark, d))


@query(f"select total, count(*) as loci from (select ref, pos, sum(depth) as total from {Q_DEPTHS} group by all) group by total")
def pileup_cumulative_depth(spark, d):
    return pileup.cumulative_depth(V.depths(spark, d))


@query(f"select sample as row, depth % 19 as col, count(*) as n from {Q_DEPTHS} group by all")
def pileup_merge(spark, d):
    cells = V.depths(spark, d).withColumns({"row": F.col("sample"), "col": F.col("depth") % 19, "half": F.col("pos") % 2})
    parts = [cells.where(F.col("half") == h).groupBy("row", "col").agg(F.count("*").alias("n")) for h in (0, 1)]
    return pileup.merge_matrices(parts[0].unionByName(parts[1]))


_COUNTS = "(select l_suppkey as ref, l_partkey as pos, l_linenumber as sample_idx, cast(sum(l_quantity) as int) as depth, " + ", ".join(
    f"cast(sum(case when l_orderkey % 4 = {i} then l_quantity else 0 end) as int) as n_{b}" for i, b in enumerate("acgt")
) + " from lineitem group by all)"
_GOOD = {b: f"(n_{b} >= 2 and n_{b} > floor(depth / 100.0))" for b in "acgt"}
_FOUND = " || ".join(f"case when {_GOOD[b]} then '{b.upper()}' else '' end" for b in "acgt")
_OTHER = " + ".join(f"case when {_GOOD[b]} then 0 else n_{b} end" for b in "acgt")
_CALL = f"""(select *, case when depth = 0 then '.' when depth < 2 or depth > 1000 or other > floor(depth / 100.0) then '?' when found = '' and other = 0 then '.'
  else coalesce(case found {' '.join(f"when '{k}' then '{v}'" for k, v in S.IUPAC.items())} end, '?') end as call
  from (select *, {_FOUND} as found, {_OTHER} as other from {_COUNTS}))"""


@query(f"select ref, pos, sample_idx, call from {_CALL}")
def mpileup_calls(spark, d):
    return pileup.call(V.base_counts(spark, d)).select("ref", "pos", "sample_idx", "call")


@query(
    f"""select ref, pos, count(*) filter (depth between 2 and 1000) as n_within, count(*) filter (call not in ('.', '?') and call <> 'A') as snps_to_ref,
    count(*) filter (call not in ('.', '?', 'A', 'C', 'G', 'T')) as het, count(*) filter (call = '?') as uncertain, true as different
    from {_CALL} group by ref, pos having n_within >= 2 and count(distinct case when call not in ('.', '?') then call end) > 1"""
)
def mpileup_loci(spark, d):
    return pileup.loci(pileup.call(V.base_counts(spark, d)))


_ADDS = ", ".join(
    f"cast(sum(case l_orderkey % 7 {' '.join(f'when {i} then {a.count(s)}' for i, (_, a) in enumerate(V.PIECES))} end) as int) as {n}" for s, n in zip(pileup.SLOTS, ("n_a", "n_c", "n_g", "n_t", "n_ins", "n_del"), strict=True)
)


@query(f"select cast(l_suppkey as varchar) as ref, l_linenumber as sample_idx, {_ADDS} from lineitem group by l_suppkey, l_linenumber")
def mpileup_parse(spark, d):
    return pileup.base_counts(V.pileup(spark, d)).select("ref", "sample_idx", "n_a", "n_c", "n_g", "n_t", "n_ins", "n_del")


# -- frames, domains, expression --------------------------------------------------------------------

_EVENTS = """(select seq_id, len, sgn, i as pos, (i - 1) % 3 + 1 as fr, substr(seq, i, 3) as c from
  (select seq_id, sgn, seq, length(seq) as len, unnest(range(1, length(seq) - 1)) as i from both_strands where length(seq) >= 3))"""


@query(
    f"""with s as {Q_LONG}, both_strands as (select seq_id, 1 as sgn, seq from s union all select seq_id, -1, {q_rc('seq')} from s),
    e as (select *, c <> 'ATG' as stop from {_EVENTS} where c in ('ATG', 'TAA', 'TAG', 'TGA')),
    p as (select *, coalesce(sum(cast(stop as int)) over (partition by seq_id, sgn, fr order by pos rows between unbounded preceding and 1 preceding), 0) as part from e),
    o as (select seq_id, len, sgn, fr, part, min(pos) filter (not stop) as a, max(pos + 2) filter (stop) as b from p group by all)
    select seq_id, case when sgn = 1 then a else len + 1 - b end as start, case when sgn = 1 then b else len + 1 - a end as "end", cast(fr * sgn as int) as frame, true as has_stop
    from o where a is not null and b is not null and b - a + 1 >= 30"""
)
def orfs(spark, d):
    return orf.find_orfs(V.long_sequences(spark, d), 30)


_HITS_VIEW = "(select distinct l_suppkey as target, l_linestatus as strand, l_partkey * 100 + l_linenumber as start, l_partkey * 100 + l_linenumber + 3 * cast(l_quantity as bigint) as \"end\" from lineitem)"


@query(
    f"""with m as (select *, coalesce(cast(start - lag("end") over w > 200 as int), 0) as new from {_HITS_VIEW} window w as (partition by target, strand order by start, "end")),
    g as (select *, sum(new) over (partition by target, strand order by start, "end" rows unbounded preceding) as group_no from m)
    select target, strand, cast(group_no as bigint) as group_no, min(start) as start, max("end") as "end", count(*) as hits from g group by target, strand, group_no"""
)
def domain_groups(spark, d):
    return domains.group_summary(domains.group_hits(V.hits(spark, d)))


_ORF_VIEW = "(select distinct l_suppkey as target, l_linestatus as strand, l_partkey * 100 as orf_start, l_partkey * 100 + 30 * l_linenumber as orf_end from lineitem)"


@query(
    f"""select target, strand, start, "end", orf_start, orf_end from (select h.*, o.orf_start, o.orf_end, row_number() over (partition by h.target, h.strand, h.start, h."end"
    order by o.orf_end - o.orf_start desc, o.orf_start, o.orf_end) as n from {_HITS_VIEW} h join {_ORF_VIEW} o on h.target = o.target and h.strand = o.strand and o.orf_start <= h."end" and o.orf_end >= h.start) where n = 1"""
)
def domain_orfs(spark, d):
    start = F.col("l_partkey") * 100
    made = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("strand"), start.alias("start"), (start + 30 * F.col("l_linenumber")).alias("end")).distinct()
    return domains.assign_orfs(V.hits(spark, d), made.withColumn("has_stop", F.lit(True))).select("target", "strand", "start", "end", "orf_start", "orf_end")


_LENGTHS = "(select gene, count(distinct p) as length from (select l_suppkey as gene, unnest(range(l_partkey * 10, l_partkey * 10 + cast(l_quantity as bigint) + 1)) as p from lineitem) group by gene)"


@query(f"select * from {_LENGTHS}")
def gene_lengths(spark, d):
    return expression.gene_lengths(V.exons(spark, d))


@query(
    f"""with l as {_LENGTHS}, r as (select l_suppkey as gene, l_returnflag as sample, cast(sum(l_quantity) as bigint) as reads from lineitem group by all),
    a as (select l.gene, s.sample, coalesce(reads, 0) as reads, coalesce(reads, 0) / length as rate from l cross join (select distinct sample from r) s left join r on r.gene = l.gene and r.sample = s.sample)
    select gene, sample, reads, floor(1e6 * rate / sum(rate) over (partition by sample) * 1000 + 0.5) / 1000 as tpm from a"""
)
def tpm(spark, d):
    reads = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").cast("long").alias("reads"))
    rows = expression.tpm(expression.gene_lengths(V.exons(spark, d)), reads)
    return rows.withColumn("tpm", S.round_half_up(F.col("tpm"), 3))  # sums of doubles differ in their last digits


# -- assembly ---------------------------------------------------------------------------------------

_TAIL = "case when max(o_orderkey) % 8 = 7 then -max(o_orderkey) - 1 else max(o_orderkey) + 1 end"
_RUNS = f"(select o_orderkey // 8 as run, string_agg({q_dna('o_orderkey')}, '' order by o_orderkey) || {q_dna(_TAIL)} as seq from orders group by 1)"
_SEEDS = """(select o_orderkey as k, case when o_orderkey % 8 <> 0 and lag(o_orderkey) over (order by o_orderkey) = o_orderkey - 1 then o_orderkey - 1 end as before,
  o_orderkey % 8 <> 7 and coalesce(lead(o_orderkey) over (order by o_orderkey) = o_orderkey + 1, false) as inside, case when o_orderkey % 8 = 7 then -o_orderkey - 1 else o_orderkey + 1 end as after from orders)"""


@query(f"select {q_canonical('seq')} as seq, length(seq) - 25 as n from {_RUNS}")
def contigs(spark, d):
    return assembly.contigs_of(V.reads(spark, d), 25).select("seq", F.col("n").cast("long").alias("n"))


@query(f"""select k as seed_id, case when before is null then 0 else 25 end as left_k, 25 as right_k,
  case when before is null then '' else substr({q_dna('before')}, 8) end || {q_dna('k')} || substr({q_dna('after')}, 1, case when inside then 25 else 32 end) as seq from {_SEEDS}""")
def seed_extension(spark, d):
    """Seeds are the 32 letters of every order; within a run they grow up to where the next seed begins."""
    key = F.col("o_orderkey")
    seeds = V.table(spark, d, "orders").select(key.alias("seed_id"), V.dna(key).alias("seq"))
    return assembly.extended_seeds(seeds, assembly.seed_extensions(seeds, V.reads(spark, d), [25], reads="seq"))


# -- demultiplexing and clusters --------------------------------------------------------------------


def _barcoded(spark, d):
    """Each order's read starts with the barcode of a nation; the fields of its id name the region's flowcell."""
    nation = V.table(spark, d, "nation")
    code = F.substring(V.dna(F.col("n_nationkey")), 1, 6)
    barcodes = nation.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("flowcell"), code.alias("barcode"), F.col("n_name").alias("sample"))
    key = F.col("o_orderkey")
    base = V.table(spark, d, "orders").select(key, (key % 25).cast("int").alias("n_nationkey"))
    seq = F.concat(code, F.when(key % 11 == 0, F.lit("TGCAA")).otherwise(F.lit("TGCAG")), V.dna(key), F.lit("CCGAGATCGGAAGG"))
    reads = base.join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), "n_nationkey").select(
        F.concat(F.lit("@m:1:f"), F.col("n_regionkey").cast("string"), F.lit(":"), key.cast("string")).alias("id"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"),
        *(F.lit(None).cast("string").alias(c) for c in ("id2", "seq2", "qual2")),
    )
    return reads, barcodes


# The read without its barcode; cut after the first CCG that the adapter's first nine letters, or a beginning of them at the end, follow.
_DEMUX = f"""(select key, n_name, status, body from (select o_orderkey as key, n_name, case when o_orderkey % 11 = 0 then 'no_remnant' else 'kept' end as status,
  case when o_orderkey % 11 = 0 then 'TGCAA' else 'TGCAG' end || {q_dna('o_orderkey')} || 'CCGAGATCGGAAGG' as body from orders join nation on n_nationkey = o_orderkey % 25))"""


@query(
    f"""with b as {_DEMUX}, c as (select key, min(i) as place from (select key, body, unnest(range(1, length(body) - 1)) as i from b) where substr(body, i, 3) = 'CCG'
    and (starts_with('AGATCGGAA', substr(body, i + 3)) or starts_with(substr(body, i + 3), 'AGATCGGAA')) group by key)
    select status, n_name as sample, case when status = 'kept' then substr(body, 1, place + 2) end as seq from b join c using (key)"""
)
def demultiplexing(spark, d):
    reads, barcodes = _barcoded(spark, d)
    return demultiplex.demultiplex(reads, barcodes).select("status", "sample", "seq")


@query(f"select status, count(*) as n from {_DEMUX} group by status")
def demultiplexing_counts(spark, d):
    reads, barcodes = _barcoded(spark, d)
    return demultiplex.status_counts(demultiplex.demultiplex(reads, barcodes))


@query(
    f"""select cast(row_number() over (order by line) as bigint) as cluster_id, 32 as aln_len, 'a' || cast(line as varchar) as id1, 'b' || cast(line as varchar) as id2, pos0 + 1 as pos,
    substr(seq1, pos0 + 1, 1) as base1, substr(seq2, pos0 + 1, 1) as base2, 'N/A' as comments, seq1, seq2 from {Q_SNPS}"""
)
def vclusters(spark, d):
    pair = F.array(F.struct(F.col("id1").alias("seq_id"), F.col("seq1").alias("aln")), F.struct(F.col("id2").alias("seq_id"), F.col("seq2").alias("aln")))
    msa = V.snps(spark, d).select(F.col("line").alias("cluster_no"), F.explode(pair).alias("s")).select("cluster_no", "s.*")
    return clusters.call_clusters(msa, clusters.ClusterOptions(("a", "b"))).drop("len1", "len2")


# sources and sinks register themselves with `query` above
from strandframe.plans import round_trips  # noqa: E402, F401
