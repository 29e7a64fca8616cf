"""Text-valued column functions: token counts, cleaning, prompt rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the benchmark's behaviour) ---------------------
# Model name -> tokenizer model name; a name that is not listed maps to itself.
MODEL_ALIASES = {
    "gpt-4": "gpt-3.5-turbo",
    "gpt-35-turbo": "gpt-3.5-turbo",
    "gpt-35-tunro": "gpt-3.5-turbo",
}
# Separator between span texts of one row.
SPAN_JOIN = ":::-:::"
# Text used for a file without answer spans.
NO_ANSWER = "N/A"
# Run-stamp layout (month-day-year-hour-minute-second).
STAMP_FORMAT = "MM-dd-yyyy-HH-mm-ss"
# -------------------------------------------------------------------------

# Default native tokenizer: runs of word characters, or any single other
# non-blank character.  ASCII classes keep Java and RE2 in agreement.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"

# Unicode whitespace as Python's str.strip() sees it (\s under UNICODE_CHARACTER_CLASS
# plus the four information separators U+001C..U+001F).
_WS = r"[\s\x{1C}-\x{1F}]"
STRIP_PATTERN = rf"(?U)^{_WS}+|{_WS}+\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Number of tokens of ``text`` under a regex tokenizer (JVM-side, codegen)."""
    return F.regexp_count(_c(text), F.lit(pattern)).cast("int")


def model_alias(model, aliases: dict[str, str] | None = None) -> Column:
    """Tokenizer name for a model name; identity when the name is not mapped."""
    aliases = MODEL_ALIASES if aliases is None else aliases
    pairs = []
    for k, v in aliases.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(m, _c(model)), _c(model))


def strip_text(text) -> Column:
    """Python-style ``strip()`` (all Unicode whitespace); null becomes ''."""
    return F.coalesce(F.regexp_replace(_c(text), STRIP_PATTERN, ""), F.lit(""))


def sanitize_blocks(contents) -> Column:
    """Drop empty lines of each block, end each block with a newline, concatenate.

    ``contents`` is an ``array<string>`` (project ``context_blocks.content``
    first so nested-column pruning reaches the scan)."""
    return F.array_join(
        F.transform(_c(contents), lambda c: F.concat(
            F.array_join(F.filter(F.split(c, "\n"), lambda line: line != ""), "\n"),
            F.lit("\n"))),
        "")


def flatten_path(path) -> Column:
    """``a/b/c.py`` -> ``a_b_c.py``."""
    return F.translate(_c(path), "/", "_")


def join_spans(spans, sep: str = SPAN_JOIN) -> Column:
    """Join an ``array<string>`` of span texts with the span separator."""
    return F.array_join(_c(spans), sep)


def run_stamp(ts) -> Column:
    return F.date_format(_c(ts), STAMP_FORMAT)


# --- prompt templates ----------------------------------------------------
# A template is plain text with ``{{ name }}`` placeholders and one loop form
# ``{% for x in name %}...{{x}}...{% endfor %}``.  Rendering turns it into a
# single ``concat`` expression; unknown names render as ''.  A ``-`` inside a tag's
# bracket drops the blanks and newlines on that side of the tag.  As with the usual
# template engine defaults, one trailing newline of the template is dropped.
_TOKEN_RE = re.compile(
    r"\{%\s*for\s+(\w+)\s+in\s+(\w+)\s*%\}(.*?)\{%\s*endfor\s*%\}|\{\{\s*(\w+)\s*\}\}",
    re.S)


def template_parts(template: str):
    """Split a template into ('text', s) / ('var', name) / ('loop', var, seq, body-parts)."""
    template = re.sub(r"\s*(\{[%{])-", r"\1", template)
    template = re.sub(r"-([%}]\})\s*", r"\1", template)
    if template.endswith("\n"):
        template = template[:-1]
    parts, pos = [], 0
    for m in _TOKEN_RE.finditer(template):
        if m.start() > pos:
            parts.append(("text", template[pos:m.start()]))
        if m.group(4):
            parts.append(("var", m.group(4)))
        else:
            parts.append(("loop", m.group(1), m.group(2), template_parts(m.group(3) + "\n")))
        pos = m.end()
    if pos < len(template):
        parts.append(("text", template[pos:]))
    return parts


def render_prompt(template: str, values: dict) -> Column:
    """Render ``template`` with column values (string columns; loops over arrays)."""
    def build(parts, scope):
        out = []
        for p in parts:
            if p[0] == "text":
                out.append(F.lit(p[1]))
            elif p[0] == "var":
                v = scope.get(p[1])
                out.append(F.coalesce(_c(v).cast("string"), F.lit("")) if v is not None else F.lit(""))
            else:
                _, var, seq, body = p
                arr = scope.get(seq)
                if arr is None:
                    continue
                out.append(F.coalesce(F.array_join(
                    F.transform(_c(arr), lambda x: build(body, {**scope, var: x})), ""), F.lit("")))
        return F.concat(*out) if out else F.lit("")
    return build(template_parts(template), dict(values))
