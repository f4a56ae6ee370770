"""Columns, types, alphabets and chain names of sequence tables.

Missing values are NULL inside the library; the neutral values '' and -1 of exchange files are turned into NULL by the readers
and back by the writers.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Core columns of a rearrangement table and their types; a table has those of them that its input has.
TEXT = (
    "sequence_id sequence sequence_aa rev_comp productive vj_in_frame stop_codon complete_vdj locus v_call d_call d2_call j_call c_call "
    "sequence_alignment germline_alignment junction junction_aa np1 np2 np3 cdr1 cdr1_aa cdr2 cdr2_aa cdr3 cdr3_aa fwr1 fwr1_aa fwr2 fwr2_aa "
    "fwr3 fwr3_aa fwr4 fwr4_aa v_cigar d_cigar j_cigar c_cigar cell_id clone_id repertoire_id sample_processing_id data_processing_id rearrangement_id"
).split()
WHOLE = "junction_length junction_aa_length duplicate_count consensus_count umi_count v_sequence_start v_sequence_end j_sequence_start j_sequence_end".split()
REAL = "v_score d_score j_score c_score v_identity d_identity j_identity c_identity".split()
TYPES = {c: T.StringType() for c in TEXT} | {c: T.LongType() for c in WHOLE} | {c: T.DoubleType() for c in REAL}
NEUTRAL = {T.StringType(): "", T.LongType(): -1, T.DoubleType(): -1.0}
FLAGS = ("productive", "vj_in_frame", "stop_codon", "rev_comp", "complete_vdj")

#: Letters of the analysis alphabets, and regions with their columns.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
NUCLEOTIDES = "ACGT"
REGIONS = {"IMGT_CDR1": "cdr1", "IMGT_CDR2": "cdr2", "IMGT_CDR3": "cdr3", "IMGT_JUNCTION": "junction", "FULL_SEQUENCE": "sequence", "IMGT_FR1": "fwr1", "IMGT_FR2": "fwr2", "IMGT_FR3": "fwr3", "IMGT_FR4": "fwr4"}

#: Loci, the names they go by, and which two make a receptor.
LOCI = {
    "TRA": ("TRA", "TCRA", "A", "ALPHA"),
    "TRB": ("TRB", "TCRB", "B", "BETA"),
    "TRG": ("TRG", "TCRG", "G", "GAMMA"),
    "TRD": ("TRD", "TCRD", "D", "DELTA"),
    "IGH": ("IGH", "H", "HEAVY"),
    "IGL": ("IGL", "L", "LIGHT", "LAMBDA"),
    "IGK": ("IGK", "K", "KAPPA"),
}
PAIRS = {"TRA_TRB": ("TRA", "TRB"), "TRG_TRD": ("TRG", "TRD"), "IGH_IGL": ("IGH", "IGL"), "IGH_IGK": ("IGH", "IGK")}

LOCUS_OF = {name: locus for locus, names in LOCI.items() for name in names}


def region_column(region: str, sequence_type: str = "AMINO_ACID") -> str:
    """The column that holds a region: cdr3_aa, junction, ..."""
    return REGIONS[region] + ("_aa" if sequence_type == "AMINO_ACID" else "")
