"""``Label: value`` fields written inside a title or a summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse_spaces, strip_chars, text_or_empty

# The labels that start a field and end the one before.
LABELS = [
    "Paper ID",
    "arXiv",
    "DOI",
    "Repository",
    "Repo",
    "GitHub repository",
    "Citation count",
    "Citations",
    "Benchmark",
    "Benchmark name",
    "Metric",
    "Metric name",
    "Metric value",
    "Score",
    "Dataset",
]

# "GitHub repository:" also is a "repository:" label, and its value is the same.
_ALSO = {"repository": "github repository"}

# Private-use characters mark where a label starts and where its value starts.
_FIELD, _VALUE = "\ue000", "\ue001"
# The first test only looks at one letter, which rules out most places of a text.
_PATTERN = (
    "(?i)(?=["
    + "".join(sorted({label[0].lower() for label in LABELS}))
    + r"])(?<![\p{L}\p{N}_])("
    + "|".join(sorted(LABELS, key=len, reverse=True))
    + r")\s*[:=]\s*"
)


def labelled_fields(title: Column | str, summary: Column | str) -> Column:
    """Array of ``label, value`` structs in text order, from one pass over the text.

    A value runs to the next known label. Keep the result in a column and read it with :func:`field`.
    """
    text = collapse_spaces(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(summary)))
    marked = F.regexp_replace(text, _PATTERN, f"{_FIELD}$1{_VALUE}")
    pieces = F.slice(F.split(marked, _FIELD), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.lower(F.substring_index(p, _VALUE, 1)).alias("label"),
            strip_chars(F.substring_index(p, _VALUE, -1), " \t\r\n.;,").alias("value"),
        ),
    )


def field(fields: Column | str, *labels: str) -> Column:
    """Value of the first label that occurs at all (its first occurrence), else the empty string."""
    fields = col(fields)

    def first_value(label: str) -> Column:
        names = [n for n in (label.lower(), _ALSO.get(label.lower())) if n]
        return F.get(F.filter(fields, lambda f: f["label"].isin(names)), F.lit(0))["value"]

    return F.coalesce(*[first_value(label) for label in labels], F.lit(""))
