"""The prompt template (our own wording).  ``{{ name }}`` placeholders and one loop form
``{% for x in seq %}...{% endfor %}``; see ``functions.text.render_prompt``."""

SPAN_PROMPT = """You check Python files against the rule "{{ query_name }}": {{ description }}

How to answer:
- copy every piece of code that breaks the rule exactly as the file has it, one after another;
- when nothing in the file breaks it, answer N/A and add nothing.

The file to check:
```python
{{ input_code }}
```

Two checked files for comparison. In the first, the rule is broken:
```python
{{ positive_context }}
```
and the right answer was:
{% for span in positive_spans %}
{{span}}
{% endfor %}
In the second, it is not:
```python
{{ negative_context }}
```
and the right answer was N/A.

Your answer for the file to check:
"""
