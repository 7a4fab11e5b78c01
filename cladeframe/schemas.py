"""Tables of a network: a set of trees whose branches carry mutations of blocks and bases.

Every table has tree_id, by which it is partitioned on disk. A base is placed by block_id, pos and
gap_pos: gap_pos is -1 for the main base at pos and 0, 1 ... for the insert-only columns before it;
pos = length of the consensus holds the columns behind the last base.
"""

from __future__ import annotations

NODE = (
    "tree_id int, node_id int, name string, parent_id int, child_ord int, pre int, post int, level int, "
    "branch_len float, is_leaf boolean, annotations array<string>"
)
BLOCK = "tree_id int, block_id int, consensus string"
GAP = "tree_id int, block_id int, pos int, len int"
#: type is S(ubstitution), I(nsertion) or D(eletion); chars has len characters, '-' for deletions.
NUC_MUT = "tree_id int, node_id int, ord int, block_id int, pos int, gap_pos int, type string, len int, chars string"
#: kind is ins, ins_inv, del or inv (strand flip).
BLOCK_MUT = "tree_id int, node_id int, ord int, block_id int, kind string"
#: Per sequence: its start within a circle, the present block that it starts with, and whether it is read backwards.
SEQ_META = "tree_id int, node_id int, circ_offset int, rot_block int, inverted boolean"
#: Event R(ecombination) or H(orizontal transfer) between two parents and a child, with its bounds on both.
COMPLEX_MUT = (
    "type string, tree1 int, seq1 string, tree2 int, seq2 string, s1 bigint, e1 bigint, s2 bigint, e2 bigint, tree3 int, seq3 string"
)

TABLES = {
    "node": NODE,
    "block": BLOCK,
    "gap": GAP,
    "nuc_mut": NUC_MUT,
    "block_mut": BLOCK_MUT,
    "seq_meta": SEQ_META,
    "complex_mut": COMPLEX_MUT,
}

#: Bases in one packed mutation record.
MAX_RUN = 6
