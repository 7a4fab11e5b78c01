"""Column expressions on bases, sequences and packed records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base of each 4-bit code 0..15, complements, and amino acids by codon.
BASES = "-ACMGRSVTWYHKDBN"
_HEX = "0123456789ABCDEF"
COMPLEMENT_FROM = "ACGTRYSWKMBDHVN"
COMPLEMENT_TO = "TGCAYRSWMKVHDBN"
#: One letter for each codon in the order TCAG of the three bases, '*' for stops.
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
THREE = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "*": "*",
}


def _table(keys: str, values: list) -> Column:
    return F.create_map(*[x for k, v in zip(keys, values) for x in (F.lit(k), F.lit(v))])


def base_code(base: Column) -> Column:
    """4-bit code of an IUPAC base: A 1, C 2, G 4, T 8, ambiguous bases their union; anything else 0."""
    at = F.instr(F.lit(BASES[1:]), base)
    return F.when(F.length(base) == 1, at).otherwise(0).cast("int")


def code_base(code: Column) -> Column:
    """Base of a 4-bit code; '-' for 0."""
    return F.substring(F.lit(BASES), code + 1, F.lit(1))


def state_of(code: Column) -> Column:
    """One bit for each code, so that an ambiguous base is a state of its own."""
    return F.call_function("shiftleft", F.lit(1), code)


def state_code(state: Column) -> Column:
    """Code of the highest bit that is set; null without one."""
    return F.when(state > 0, F.length(F.bin(state)) - 1).cast("int")


def lowest_bit(state: Column) -> Column:
    return state.bitwiseAND(-state)


def complement(seq: Column) -> Column:
    """IUPAC complement of each character; whatever has none becomes N."""
    known = F.regexp_replace(seq, f"[^{COMPLEMENT_FROM}]", "N")
    return F.translate(known, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def strip_gaps(seq: Column) -> Column:
    """Without gaps and end marks."""
    return F.translate(seq, "-x", "")


def wrap(seq: Column, width: int = 70) -> Column:
    """Lines of width characters, without a line break at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def quoted_split(text: Column) -> Column:
    """Parts between commas that stand outside single quotes, trimmed."""
    return F.transform(F.split(text, ",(?=(?:[^']*'[^']*')*[^']*$)"), lambda x: F.trim(x))


def pack_consensus(seq: Column) -> Column:
    """Codes of eight bases a number, the first in the highest four bits; anything but a base is 0."""
    known = F.regexp_replace(seq, f"[^{BASES[1:]}]", "-")
    digits = F.translate(known, BASES, _HEX)
    padded = F.concat(digits, F.repeat(F.lit("0"), F.pmod(-F.length(digits), F.lit(8))))
    return F.transform(F.regexp_extract_all(padded, F.lit(".{8}"), 0), lambda w: F.conv(w, 16, 10).cast("bigint"))


def unpack_consensus(words: Column) -> Column:
    """The bases of packed numbers up to the first code 0."""
    digits = F.transform(words, lambda w: F.lpad(F.hex(w.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.substring_index(F.translate(F.array_join(digits, ""), _HEX, BASES), "-", 1)


def pack_run(codes: Column) -> Column:
    """Up to six codes in 24 bits, the first in the highest four."""
    used = F.aggregate(codes, F.lit(0), lambda acc, c: acc * 16 + c)
    return F.call_function("shiftleft", used, (6 - F.size(codes)) * 4)


def run_code(packed: Column, j: Column | int) -> Column:
    """Code j of a packed run."""
    return F.call_function("shiftright", packed, (5 - (F.lit(j) if isinstance(j, int) else j)) * 4).bitwiseAND(15)


def pack_block_id(primary: Column, secondary: Column) -> Column:
    return F.call_function("shiftleft", primary.cast("bigint"), F.lit(32)) + secondary.cast("bigint")


def unpack_block_id(packed: Column) -> tuple[Column, Column]:
    return F.call_function("shiftright", packed, F.lit(32)).cast("int"), packed.bitwiseAND(0xFFFFFFFF).cast("int")


def mutation_info(kind: Column, length: Column) -> Column:
    """Type in the low four bits, length above."""
    return (length * 16 + kind).cast("int")


def codon_residue(codon: Column) -> Column:
    """Three-letter amino acid of a codon, '*' for a stop; null unless all three are A, C, G or T."""
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    table = F.create_map(*[x for k, r in zip(codons, RESIDUES) for x in (F.lit(k), F.lit(THREE[r]))])
    return F.try_element_at(table, codon)


def only_bases(seq: Column) -> Column:
    """Whatever is not A, C, G or T becomes a gap."""
    return F.regexp_replace(seq, "[^ACGT]", "-")


def expanded(code: Column) -> Column:
    """0..3 for each of A, C, G, T that a code stands for."""
    return F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.call_function("shiftright", code, i).bitwiseAND(1) == 1)


def file_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMd")


def mutation_text(old: Column, pos: Column, new: Column, in_gap: Column) -> Column:
    """Old base, position, new base; g in front where the root has a gap."""
    return F.concat(F.when(in_gap, F.lit("g")).otherwise(F.lit("")), old, pos.cast("string"), new)


def merged_type(first: Column, second: Column) -> Column:
    """Type of two successive mutations of one base; null where an insertion is deleted again."""
    return (
        F.when((first == "I") & (second == "D"), F.lit(None).cast("string"))
        .when((first == "I") & (second == "S"), F.lit("I"))
        .when((first == "D") & (second == "I"), F.lit("S"))
        .when((first == "D") & (second == "S"), F.lit("S"))
        .when((first == "S") & (second == "I"), F.lit("S"))
        .otherwise(second)
    )
