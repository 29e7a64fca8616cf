"""Declared schemas, readers and writers (sources/sinks A1-A8)."""

from spanlake.sources.schemas import (  # noqa: F401
    EXAMPLES, QUERY_META, RESPONSE_LOG_FIXED, response_log_schema,
)
from spanlake.sources.readers import (  # noqa: F401
    read_examples, read_query_meta, read_response_logs, read_source_files, read_vocab, reload,
)
from spanlake.sources.stages import read_stage, write_stage  # noqa: F401
from spanlake.sources.writers import (  # noqa: F401
    materialize, write_prompts, write_response_logs, write_vocab,
)
