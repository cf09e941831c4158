"""The queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.clusters import OP13_SQL, op13_hamerly_bounds
from quarrylight.llm.decontamination import op1_spaced_seeds
from quarrylight.llm.infilling import OP12_SQL, op12_split_infilling
from quarrylight.llm.jaccard import OP11_SQL, op11_signature_trees, sql
from quarrylight.llm.languages import op4_chain_field
from quarrylight.llm.licenses import op5_signature_rules
from quarrylight.llm.neardup import op3_odd_sketches
from quarrylight.llm.neighbours import op9_shifted_curves
from quarrylight.llm.pages import op10_style_tree
from quarrylight.llm.packing import op2_nnls_packing
from quarrylight.llm.secrets import op6_credential_links
from quarrylight.llm.sharding import op8_virtual_slots
from quarrylight.llm.toxicity import op7_kneser_ney


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spaced_seeds": op1_spaced_seeds,
        "op2_nnls_packing": op2_nnls_packing,
        "op3_odd_sketches": op3_odd_sketches,
        "op4_chain_field": op4_chain_field,
        "op5_signature_rules": op5_signature_rules,
        "op6_credential_links": op6_credential_links,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_virtual_slots": op8_virtual_slots,
        "op9_shifted_curves": op9_shifted_curves,
        "op10_style_tree": op10_style_tree,
        "op11_signature_trees": op11_signature_trees,
        "op12_split_infilling": op12_split_infilling,
        "op13_hamerly_bounds": op13_hamerly_bounds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_odd_sketches": f"SELECT *, doc_id = component_id AS kept FROM ({sql(4, 80)})",
        "op11_signature_trees": OP11_SQL,
        "op12_split_infilling": OP12_SQL,
        "op13_hamerly_bounds": OP13_SQL,
    }
