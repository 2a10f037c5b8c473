"""Column functions over sequences. All are built-in expressions, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids of the standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Ambiguity codes of sets of bases.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}


def complement(s: Column) -> Column:
    """Bases in either case; any other character stays."""
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return complement(F.reverse(s))


def canonical(s: Column) -> Column:
    """The smaller of a sequence and its reverse complement, case-sensitive."""
    return F.least(s, reverse_complement(s))


def is_canonical(s: Column, start: int | None = None, end: int | None = None) -> Column:
    """Whether a sequence, or its 0-based half-open range, is its own canonical form; palindromes are."""
    part = s if start is None else F.substring(s, start + 1, end - start)
    return part <= reverse_complement(part)


def kmers(s: Column, k: int) -> Column:
    """All windows of length k, in order; none for shorter sequences."""
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, windows).otherwise(F.array().cast("array<string>"))


def canonical_kmers(s: Column, k: int) -> Column:
    """The canonical form of each window. The sequence is complemented once: what stands opposite a window is a window of that."""
    last = F.length(s) - (k - 1)
    windows = lambda rc: F.transform(F.sequence(F.lit(1), last), lambda i: F.least(F.substr(s, i, F.lit(k)), F.substr(rc, last + 1 - i, F.lit(k))))
    # as the element of an array the complement is a variable of the inner loop and not evaluated again for each window
    return F.when(F.length(s) >= k, F.transform(F.array(reverse_complement(s)), windows)[0]).otherwise(F.array().cast("array<string>"))


def only_acgt(s: Column) -> Column:
    return ~s.rlike("[^ACGTacgt]")


def has_n(s: Column) -> Column:
    return s.rlike("[Nn]")


def translate(s: Column, codons: dict[str, str] | None = None) -> Column:
    """Amino acids of the codons from the start; trailing bases are left out, unknown codons are X, stops *."""
    if codons is not None:
        table = F.create_map(*(F.lit(x) for pair in codons.items() for x in pair))
        amino = lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))
    else:

        def amino(c: Column) -> Column:
            places = [F.instr(F.lit(CODON_BASES), F.substr(c, F.lit(i), F.lit(1))) - 1 for i in (1, 2, 3)]
            known = ~c.rlike("[^ACGT]")
            return F.when(known, F.substr(F.lit(AMINO_ACIDS), places[0] * 16 + places[1] * 4 + places[2] + 1, F.lit(1))).otherwise(F.lit("X"))

    starts = F.sequence(F.lit(1), F.length(s) - 2, F.lit(3))
    return F.when(F.length(s) >= 3, F.array_join(F.transform(starts, lambda i: amino(F.upper(F.substr(s, i, F.lit(3))))), "")).otherwise(F.when(s.isNotNull(), F.lit("")))


def ungap(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit(""))


def gaps_before(s: Column, position: Column) -> Column:
    """Gap characters in the first `position` characters."""
    head = F.substr(s, F.lit(1), position)
    return F.length(head) - F.length(ungap(head))


def unpadded_position(s: Column, position: Column) -> Column:
    """Where a 0-based position of a gapped sequence lies without the gaps."""
    return position - gaps_before(s, position)


def iupac(bases: Column) -> Column:
    """Ambiguity code of an array of bases; null where it is empty."""
    table = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    return F.try_element_at(table, F.array_join(F.array_sort(F.array_distinct(bases)), ""))


def iupac_bases(code: Column) -> Column:
    """The bases that an ambiguity code stands for."""
    table = F.create_map(*(F.lit(x) for k, v in IUPAC.items() for x in (v, k)))
    return F.split(F.try_element_at(table, F.upper(code)), "")


def pair_code(first: Column, second: Column) -> Column:
    """Code of a call of up to two alleles: `n` with a gap among two, `N` for none."""
    both = F.array_compact(F.array(first, second))
    two = F.size(F.array_distinct(both)) > 1
    return F.when(F.size(both) == 0, F.lit("N")).when(two & ((first == "-") | (second == "-")), F.lit("n")).when(two, iupac(both)).otherwise(both[0])


def alleles_text(first: Column, second: Column) -> Column:
    """`A/C`, a single allele, or `N`."""
    return F.when(first.isNull() & second.isNull(), F.lit("N")).otherwise(F.concat_ws("/", first, second))


def parents_text(first: Column, second: Column, base1: Column, base2: Column) -> Column:
    """`AA`, `BB`, `AB` against the parents' bases; `NN` for no call."""
    one = F.coalesce(first, second)
    return (
        F.when(first.isNull() & second.isNull(), F.lit("NN")).when(first.isNotNull() & second.isNotNull(), F.lit("AB")).when(one == base1, F.lit("AA")).when(one == base2, F.lit("BB")).otherwise(F.lit("nn"))
    )


def slash(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("/"), b.cast("string"))


def evidence_text(cov1: Column, freq1: Column, cov2: Column, freq2: Column) -> Column:
    """`coverage x frequency` of both alleles, with an empty-set sign where nothing was seen."""
    one = lambda c, f: F.when(c > 0, F.concat(c.cast("string"), F.lit("x"), f.cast("string"))).otherwise(F.lit("∅"))
    return F.concat_ws("/", one(cov1, freq1), one(cov2, freq2))


def median0(x: Column) -> Column:
    """Median as an aggregate; 0 where there is no value."""
    return F.coalesce(F.median(x), F.lit(0.0))


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits
