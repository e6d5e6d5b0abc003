"""k-mer functions as Column expressions. A k-mer is an integer, two bits a base (A 0, C 1, G 2, T 3), first base highest; k-mers with any other letter are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def clean(text: Column) -> Column:
    """Upper case, letters other than ACGT removed."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_count(k: int) -> int:
    return 4**k


def encode(kmer: Column) -> Column:
    """String to integer; null where a letter is not a base."""
    value = F.conv(F.translate(F.upper(kmer), BASES, "0123"), 4, 10).cast("long")
    return F.when(kmer.rlike("^[ACGTacgt]+$"), value)


def at(seq: Column, offset: Column | int, k: int) -> Column:
    """The integer k-mer that starts at a 0-based offset."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return encode(F.substr(seq, off + F.lit(1), F.lit(k)))


def decode(kmer: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer, 10, 4), k, "0"), "0123", BASES)


def comp(kmer: Column, k: int) -> Column:
    return kmer.bitwiseXOR(F.lit(4**k - 1).cast("long"))


def revcomp(kmer: Column, k: int) -> Column:
    """Reverse complement by shifts: base i moves to place k - 1 - i and is complemented."""
    out = F.lit(0).cast("long")
    for i in range(k):
        base = F.shiftright(kmer, 2 * i).bitwiseAND(F.lit(3).cast("long"))
        out = out.bitwiseOR(F.shiftleft(F.lit(3).cast("long").bitwiseXOR(base), 2 * (k - 1 - i)))
    return out


def base_at(kmer: Column, i: int, k: int) -> Column:
    return F.shiftright(kmer, 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long"))


def head(kmer: Column, k: int) -> Column:
    return base_at(kmer, 0, k)


def neighbor(kmer: Column, base: Column | int, k: int) -> Column:
    b = F.lit(base).cast("long") if isinstance(base, int) else base
    return F.shiftleft(kmer, 2).bitwiseAND(F.lit(4**k - 1).cast("long")).bitwiseOR(b)


def starts(seq: Column, k: int) -> Column:
    """0-based starts of all k-mers (an empty array for shorter sequences)."""
    n = F.char_length(seq) - F.lit(k - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order, as strings: one pass of a look-ahead over the sequence, whatever its length."""
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def base_kmers(seq: Column, k: int) -> Column:
    """The k-mers of bases only (either case), in order."""
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?=([ACGTacgt]{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def revcomp_array(kmers_: Column, k: int) -> Column:
    """The integer k-mers of the opposite strand, in its order."""
    return F.transform(F.reverse(kmers_), lambda x: revcomp(x, k))


def subsequence(seq: Column, st: Column, en: Column, is_fwd: Column) -> Column:
    """The half-open span [st, en) of a sequence, of the opposite strand if not forward."""
    part = F.substr(seq, (st + 1).cast("int"), F.greatest(en - st, F.lit(0)).cast("int"))
    return F.when(is_fwd, part).otherwise(reverse_complement(part))
