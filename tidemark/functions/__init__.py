"""Scalar column functions (N1..N30).

These replace the reference's per-cell Python callables (X1) and per-row logic (X2) with
built-in Spark expressions, so they stay inside whole-stage codegen.  Its custom
aggregate (X3) is ``operators.aggregate.join_unique`` (A2) and its 1->N generators (X4)
are ``operators.expand.expand_daily`` / ``split_periods`` (E1, E2).
"""
from .jsontext import clean_llm_json, clean_llm_text
from .masking import mask_name, mask_phone
from .scalars import (BLANK_TOKENS, COMPASS_16, EXT_TYPE, WEEKDAY_KOR, blank_string_to_null,
                      calendar_parts, code_label, col_of, compass16, contains_any,
                      date_key, date_prefix_depth, format_ntz, ensure_sn, ext_type, file_ext, first_line,
                      int_like_float_to_string, is_blank, item_id, num_text, recency_class,
                      recency_label, round_half_even, snippet, str_or_empty, strip,
                      strip_date_prefixes, suffix_override, to_int_default, to_number)
from .timeparse import (BASE_TIMES, GENERAL_FORMATS, PERMIT_FORMATS, excel_serial_to_ts,
                        parse_date_flex, parse_ts_by_type, parse_ts_formats, parse_ts_mixed,
                        parse_with_formats,
                        publication_slot)

__all__ = [n for n in dir() if not n.startswith("_")]
