"""All driver-table queries and their DuckDB oracles, by name."""

from __future__ import annotations

from . import scoring

QUERIES = {}
ORACLE_SQL = {}


def _register(module, names):
    for name in names:
        QUERIES[name] = getattr(module, name)
        if name in module.SQL:
            ORACLE_SQL[name] = module.SQL[name]


_register(scoring, ["scorecard_exact", "scorecard_overall", "match_coverage",
                    "mismatch_first10", "category_rollup", "pii_report"])

from . import rule_queries  # noqa: E402

_register(rule_queries, ["rule_text", "rule_enum", "rule_number", "rule_date", "rule_state",
                         "rule_lists"])

from . import collection_queries  # noqa: E402

_register(collection_queries, ["set_overlap", "set_equal", "count_match", "first_element",
                               "financial_scorecard"])

from . import claim_queries  # noqa: E402

_register(claim_queries, ["section_rules", "invented_list", "align_pairs", "record_accuracy",
                          "error_table"])

from . import misc_queries  # noqa: E402

_register(misc_queries, ["scores_minmax", "best_row", "methods_pivot", "record_id_slice", "row_index", "reshape",
                         "py_literal", "ndjson_roundtrip", "display_name", "prediction_files", "line_numbers", "json_array_files"])

from . import bundles  # noqa: E402

_register(bundles, ["bundle_practitioners"])
_register(bundles, ["bundle_fields", "bundle_lists", "bundle_file_gold"])

from . import extraction  # noqa: E402

_register(extraction, ["extract_patterns", "extract_structured", "prompt_text", "schema_violations",
                       "assertions"])
_register(bundles, ["patient_scorecard"])

from . import output_queries  # noqa: E402

_register(output_queries, ["claim_type_failures", "indexed_assertions", "claim_violations", "extract_round_robin",
                           "stored_records", "nested_counts", "financial_lists"])
