"""Column functions; every one is a plain Spark SQL expression."""

from notegrid.functions.profile import (
    abs_difference, char_seed, clamp, distance, equal_or_null, field_position, map_encodings, map_point, node_size, procedural_mark, range_track, range_width, score, score_to_percent,
)
from notegrid.functions.text import (
    bilingual, caption, comma_list, decode, first_present, href, is_home, join_list, normalize_term, ordinal_label, query_parameter, search_text, strip_js, to_fixed, trailing_slash, upper_label,
)
from notegrid.functions.url import url_fault

__all__ = [
    "abs_difference", "bilingual", "caption", "char_seed", "clamp", "comma_list", "decode", "distance", "equal_or_null", "field_position", "first_present", "href", "is_home",
    "join_list", "map_encodings", "map_point", "node_size", "normalize_term", "ordinal_label", "procedural_mark", "query_parameter", "range_track", "range_width",
    "score", "score_to_percent", "search_text", "strip_js", "to_fixed", "trailing_slash", "upper_label", "url_fault",
]
