"""Column-level helpers (predicates, null-exact aggregates, string rules)."""

from ephysframe.functions.columns import (  # noqa: F401
    all_of, any_of, list_lacks, match_term, n_unique, first_by, row_mean,
    split_terms, split_part, replace_first, strict_concat,
    format_probe_name, blank_to_null, hex_to_int,
    parse_id_list, clamp01, round_half_up_ratio,
)
