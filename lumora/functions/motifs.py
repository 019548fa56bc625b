"""Regular-expression features of sequences, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature name and pattern, matched anywhere in the upper-cased sequence.
FLAGS = [
    ("DFG_present", "DFG"),
    ("DFG_flanking_A", ".DFG"),
    ("DFG_flanking_B", "DFG."),
    ("DFG_in", "DFG[IL]"),
    ("DFG_out", "DFG[^IL]"),
    ("HRD_present", "HRD"),
    ("HRD_K", "HRD[LIV]K"),
    ("APE_present", "APE"),
    ("APE_L", "APEL"),
    ("GxGxxG", "G.G..G"),
    ("GXGXFG", "G.G.FG"),
    ("VAIK", "VA[IL]K"),
    ("VAIK_alt", "V[AI][IL]K"),
    ("DFGxxx", "DFG..."),
    ("activation_ELK", "E[LIV]K"),
    ("gatekeeper_T", "[LI]T[IV]"),
    ("gatekeeper_M", "[LI]M[IV]"),
    ("ExxxK", "E...[LI]K"),
    ("ExK", "E.K"),
    ("HxH_spine", "[HY][^ACDEFGHIKLMNPQRSTVWY][HY]"),
    ("WxGxG", "W.G.G"),
    ("RD_kinase", "R[^P]D[LIVF]"),
    ("TxY_motif", "T.Y"),
    ("YxxM_motif", "Y..M"),
    ("pY_motif", "Y[DE][DE]"),
    ("Fxx[FY]", "F..[FY]"),
    ("CK1_motif", "S..S"),
    ("KxK_CMGC", "K.K"),
    ("NPXY", "NP.Y"),
    ("acidic_cluster", "[DE]{3,}"),
]
#: Named motif, pattern, colour, what it is. Later ones overwrite earlier ones' positions.
NAMED = [
    ("VAIK", "[VIL][AG][IV]K", "#e74c3c", "β3-Lys (ATP binding)"),
    ("HRD", "HRD", "#3498db", "Catalytic loop"),
    ("DFG", "DFG", "#2ecc71", "Activation loop"),
    ("APE", "APE", "#f39c12", "Activation loop"),
    ("P-loop", "G.G..G", "#9b59b6", "ATP phosphate coordination"),
]
GATEKEEPER_COLOUR, GATEKEEPER_BEFORE, WRAP = "#e67e22", 15, 60


def flag_name(name: str) -> str:
    return re.sub(r"\W", "_", name)


def _core(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds."""
    return max(re.sub(r"\[[^]]*\](\{[^}]*\})?|[^A-Z]", " ", pattern).split(), key=len, default="")


def matches(upper: Column, pattern: str) -> Column:
    """Whether a pattern occurs; a plain search for letters that it can't do without comes first."""
    core = _core(pattern)
    if core == pattern:
        return upper.contains(pattern)
    return upper.contains(core) & upper.rlike(pattern) if len(core) > 1 else upper.rlike(pattern)


def flags(seq: Column) -> list[Column]:
    """One INT column for each of FLAGS; a null sequence counts as empty."""
    upper = F.upper(F.coalesce(seq, F.lit("")))
    return [matches(upper, pattern).cast("int").alias(flag_name(name)) for name, pattern in FLAGS]


def first_match(seq: Column, pattern: str) -> Column:
    """struct(found, sequence, position): the first match and its 1-based place, null if there is none."""
    at = F.regexp_instr(seq, F.lit(pattern))
    return F.struct((at > 0).alias("found"), F.when(at > 0, F.regexp_substr(seq, F.lit(pattern))).alias("sequence"), F.when(at > 0, at).alias("position"))


def gatekeeper(seq: Column) -> Column:
    """struct(residue, position): the residue GATEKEEPER_BEFORE places before the first DFG, null if that is outside."""
    at = F.regexp_instr(seq, F.lit("DFG")) - GATEKEEPER_BEFORE
    return F.when(at >= 1, F.struct(F.substring(seq, at, F.lit(1)).alias("residue"), at.alias("position")))


def _places(seq: Column) -> list[tuple[Column, Column, str]]:
    """(first position, last position, colour) of what is painted, in order; null positions where it isn't there."""
    out = []
    for _, pattern, colour, _ in NAMED:
        at = F.nullif(F.regexp_instr(seq, F.lit(pattern)), F.lit(0))
        out.append((at, at + F.length(F.regexp_substr(seq, F.lit(pattern))) - 1, colour))
    at = F.regexp_instr(seq, F.lit("DFG")) - GATEKEEPER_BEFORE
    at = F.when(at >= 1, at)
    return [*out, (at, at, GATEKEEPER_COLOUR)]


def highlighted(seq: Column) -> Column:
    """The sequence as HTML, WRAP residues a line, with coloured motif residues: named motifs in order, then the gatekeeper, the last one wins."""
    painted = _places(seq)
    # places are found once, in a struct that the positions' lambda reads
    once = F.struct(seq.alias("s"), *(x.alias(f"{n}{k}") for k, (lo, hi, _) in enumerate(painted) for n, x in (("lo", lo), ("hi", hi))))

    def show(m: Column) -> Column:
        def residue(i: Column) -> Column:
            colour = F.coalesce(*(F.when((i >= m[f"lo{k}"]) & (i <= m[f"hi{k}"]), c) for k, (_, _, c) in reversed(list(enumerate(painted)))))
            letter = F.substring(m["s"], i, F.lit(1))
            return F.when(colour.isNotNull(), F.concat(F.lit('<span style="background: '), colour, F.lit('">'), letter, F.lit("</span>"))).otherwise(letter)

        def line(n: Column) -> Column:
            first, last = n * WRAP + 1, F.least(n * WRAP + WRAP, F.length(m["s"]))
            touched = F.coalesce(*(F.when((m[f"lo{k}"] <= last) & (m[f"hi{k}"] >= first), True) for k in range(len(painted))), F.lit(False))
            # only lines with something painted are gone through letter by letter
            return F.when(touched, F.array_join(F.transform(F.sequence(first, last), residue), "")).otherwise(F.substring(m["s"], first, F.lit(WRAP)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(m["s"]) - 1) / WRAP).cast("int")), line), "<br>")

    return F.when(F.length(seq) > 0, F.transform(F.array(once), show)[0]).otherwise(F.lit(""))
