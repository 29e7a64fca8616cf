"""Column expressions (no Python at run time): text, sequence, span and match helpers."""

from spanlake.functions.text import (  # noqa: F401
    MODEL_ALIASES, TOKEN_PATTERN, flatten_path, join_spans, model_alias, render_prompt,
    run_stamp, sanitize_blocks, strip_text, token_count,
)
from spanlake.functions.sequences import (  # noqa: F401
    argmax_labels, first_sep_index, input_mask, pad_truncate, regroup, segment_ids,
)
from spanlake.functions.spans import (  # noqa: F401
    extract_spans, extract_spans_twostep, same_spans, span_set_equal, spans_to_string,
    twostep_spans_to_string,
)
from spanlake.functions.matching import (  # noqa: F401
    fuzzy_match, match_flags, pass_at_k_scalar, span_match, with_legacy_flags,
)
