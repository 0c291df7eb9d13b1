"""Split one CSV line into fields without knowing how many there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A field follows a comma; possessive quantifiers keep the match linear on long quoted text.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf',("{_BODY}(?:"[^,]*+)?|[^,]*+)'


def _unquote(field: Column) -> Column:
    body = F.replace(F.regexp_extract(field, rf'^"({_BODY})', 1), F.lit('""'), F.lit('"'))
    rest = F.regexp_replace(field, rf'^"{_BODY}"?', "")
    return F.when(field.startswith('"'), F.concat(body, rest)).otherwise(field)


def split_csv(line: Column) -> Column:
    """Array of field values: doubled quotes undone, commas inside quotes kept, nothing trimmed."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), _unquote)
