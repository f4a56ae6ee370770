"""Column functions on sequences: k-mers, positions, genes, translation, motifs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AMINO_ACIDS, LOCUS_OF


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def starts(length: Column, width: int, step: int = 1) -> Column:
    """1, 1 + step, ... as far as width letters fit; empty if none fit (a descending sequence() would not be)."""
    return F.when(length >= width, F.sequence(F.lit(1), length - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def kmers(seq: Column | str, k: int, overlapping: bool = True) -> Column:
    seq = col(seq)
    return F.transform(starts(F.length(seq), k, 1 if overlapping else k), lambda i: F.substring(seq, i, F.lit(k)))


def gapped_kmers(seq: Column | str, left: int, right: int, least: int, most: int) -> Column:
    """left letters, g dots, right letters, for each gap g from least to most."""
    seq = col(seq)

    def with_gap(g: int) -> Column:
        word = lambda i: F.concat(F.substring(seq, i, F.lit(left)), F.lit("." * g), F.substring(seq, i + (left + g), F.lit(right)))
        return F.transform(starts(F.length(seq), left + g + right), word)

    return F.concat(*[with_gap(g) for g in range(least, most + 1)])


def _numbers(first: Column, last: Column, head: str = "", down: bool = False) -> Column:
    got = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.concat(F.lit(head), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.reverse(got) if down else got


def imgt_positions(length: Column, junction: bool = False) -> Column:
    """IMGT names of the positions of a CDR3 of 5 to 91 letters (a junction has one more at either end); none for other lengths.
    Up to 13 letters positions are missing from the middle, beyond that 111.1, 111.2, ... and ..., 112.2, 112.1 come in."""
    n = length - 2 if junction else length
    left = F.floor((n - 5) / 2).cast("int") + 3
    short = F.concat(_numbers(F.lit(105), left + 104), _numbers(F.lit(118) - n + left, F.lit(117)))
    extra = F.floor((n - 13) / 2).cast("int")
    long = F.concat(_numbers(F.lit(105), F.lit(111)), _numbers(F.lit(1), extra, "111."), _numbers(F.lit(1), n - 13 - extra, "112.", down=True), _numbers(F.lit(112), F.lit(117)))
    names = F.when(n <= 13, short).otherwise(long)
    if junction:
        names = F.concat(F.array(F.lit("104")), names, F.array(F.lit("118")))
    return F.when(n.between(5, 91), names).otherwise(F.array().cast("array<string>"))


def imgt_kmers(seq: Column | str, k: int, junction: bool = False) -> Column:
    """kmer_position, the position being that of its first letter; none where positions can't be told."""
    seq = col(seq)
    names = imgt_positions(F.length(seq), junction)
    return F.when(F.size(names) > 0, F.transform(kmers(seq, k), lambda x, i: F.concat(x, F.lit("_"), F.get(names, i)))).otherwise(F.array().cast("array<string>"))


def imgt_gapped_kmers(seq: Column | str, left: int, right: int, least: int, most: int, junction: bool = False) -> Column:
    seq = col(seq)
    names = imgt_positions(F.length(seq), junction)
    parts = [F.transform(gapped_kmers(seq, left, right, g, g), lambda x, i: F.concat(x, F.lit("_"), F.get(names, i))) for g in range(least, most + 1)]
    return F.when(F.size(names) > 0, F.concat(*parts)).otherwise(F.array().cast("array<string>"))


def with_gene(words: Column, v_call: Column | str) -> Column:
    """V_kmer: k-mers with the V gene in front."""
    return F.transform(words, lambda x: F.concat(gene(v_call), F.lit("_"), x))


def with_locus(words: Column, locus: Column | str) -> Column:
    return F.transform(words, lambda x: F.concat(col(locus), F.lit("_"), x))


def all_kmers(k: int, alphabet: str = AMINO_ACIDS) -> list[str]:
    return ["".join(x) for x in product(sorted(alphabet), repeat=k)]


def neighbours(seq: Column | str, alphabet: str = AMINO_ACIDS) -> Column:
    """All strings that differ in one letter at most, itself among them."""
    seq = col(seq)
    one = F.transform(starts(F.length(seq), 1), lambda i: F.transform(F.array(*map(F.lit, alphabet)), lambda a: F.overlay(seq, a, i)))
    return F.array_distinct(F.flatten(one))


def masked(seq: Column | str) -> Column:
    """The string with each letter in turn as _; two strings of Hamming distance 1 at most share one."""
    seq = col(seq)
    return F.transform(starts(F.length(seq), 1), lambda i: F.overlay(seq, F.lit("_"), i))


def deletions(seq: Column | str) -> Column:
    """The string with each letter in turn left out."""
    seq = col(seq)
    return F.array_distinct(F.transform(starts(F.length(seq), 1), lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.substring(seq, i + 1, F.length(seq)))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions at which strings of one length differ; NULL for others."""
    a, b = col(a), col(b)
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(letters, F.lit(0), lambda s, x: s + x))


def gene(call: Column | str) -> Column:
    """A call without its allele."""
    return F.split_part(col(call), F.lit("*"), F.lit(1))


def genes(call: Column | str) -> Column:
    """The genes of a comma-separated call, without alleles; empty for NULL and ''."""
    call = F.coalesce(col(call), F.lit(""))
    return F.filter(F.transform(F.split(call, ","), lambda x: F.split_part(F.trim(x), F.lit("*"), F.lit(1))), lambda x: x != "")


def genes_match(a: Column | str, b: Column | str) -> Column:
    """True if two calls share a gene, or neither has one."""
    a, b = genes(a), genes(b)
    return F.arrays_overlap(a, b) | ((F.size(a) == 0) & (F.size(b) == 0))


def locus_of(name: Column | str) -> Column:
    """The locus that a name stands for; NULL if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LOCUS_OF.items() for x in pair])
    return F.try_element_at(known, F.upper(col(name)))


#: The standard genetic code, codons in the order TCAG at each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), CODE, strict=True))


def translated(seq: Column | str) -> Column:
    """Amino acids of whole codons; an unknown codon is _, a partial one at the end is left out."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    return F.array_join(F.transform(kmers(seq, 3, overlapping=False), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("_"))), "")


def inner(seq: Column | str, cut: int) -> Column:
    """A string without its first and last cut letters; '' if there are none left."""
    seq = col(seq)
    return F.when(F.length(seq) > 2 * cut, F.substring(seq, F.lit(cut + 1), F.length(seq) - 2 * cut)).otherwise(F.when(seq.isNotNull(), F.lit("")))


def padded(seq: Column | str, size: int, letter: str = "_") -> Column:
    """A string brought to a size by letters in its middle."""
    seq = col(seq)
    half = F.ceil(F.length(seq) / 2).cast("int")
    return F.concat(F.substring(seq, F.lit(1), half), F.repeat(F.lit(letter), F.greatest(F.lit(size) - F.length(seq), F.lit(0))), F.substring(seq, half + 1, F.length(seq)))


def has_motif(seq: Column | str, positions: list[int], letters: list[str]) -> Column:
    """True if each position (from 0) has one of its letters; a lower-case letter stands for any other one."""
    test = F.lit(True)
    for at, some in zip(positions, letters, strict=True):
        here = F.substring(col(seq), at + 1, 1)
        one = F.lit(False)
        for a in some:
            one = one | ((here == a) if a.isupper() else (here != a.upper()))
        test = test & one
    return test


def motif_name(positions: list[int], letters: list[str]) -> str:
    return "&".join(map(str, positions)) + "-" + "&".join(letters)


def motif_of(name: str) -> tuple[list[int], list[str]]:
    at, letters = name.split("-")
    return [int(x) for x in at.split("&")], letters.split("&")


def rolling_match(seq: Column | str, pattern: str, width: int) -> Column:
    """The positions (from 0) at which a pattern of fixed width matches, overlapping ones too."""
    words = kmers(seq, width)
    return F.filter(F.transform(words, lambda w, i: F.when(F.regexp_like(w, F.lit(f"^(?:{pattern})$")), i)), lambda x: x.isNotNull())


def pwm_match(seq: Column | str, weights: list[dict[str, float]], threshold: float) -> Column:
    """The positions (from 0) at which a position weight matrix scores at least threshold."""
    table = F.array(*[F.create_map(*[F.lit(x) for pair in w.items() for x in pair]) for w in weights])

    def score(word: Column) -> Column:
        letters = F.zip_with(F.split(word, ""), table, lambda a, w: F.coalesce(F.try_element_at(w, a), F.lit(0.0)))
        return F.aggregate(letters, F.lit(0.0), lambda s, x: s + x)

    words = kmers(seq, len(weights))
    return F.filter(F.transform(words, lambda w, i: F.when(score(w) >= threshold, i)), lambda x: x.isNotNull())


def position_weights(length: int, weights: dict[str, float] | None, names: list[str]) -> dict[str, float]:
    """A weight for each position name: those given, and what is left of 1 evenly over the others."""
    weights = {k: v for k, v in (weights or {}).items() if k in names}
    rest = [n for n in names if n not in weights]
    left = max(0.0, 1.0 - sum(weights.values()))
    full = {n: weights.get(n, left / len(rest) if rest else 0.0) for n in names[:length]}
    total = sum(full.values())
    return {k: v / total for k, v in full.items()} if total else {k: 1 / len(full) for k in full}
