"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from .operators import distances, language_models, prosody, specs, syllables, words
from .plans import transcribe

QUERIES: dict = {**transcribe.QUERIES, **words.QUERIES, **distances.QUERIES, **language_models.QUERIES, **prosody.QUERIES, **syllables.QUERIES, **specs.QUERIES}
ORACLE_SQL: dict = {**transcribe.ORACLE_SQL, **words.ORACLE_SQL, **distances.ORACLE_SQL, **language_models.ORACLE_SQL, **prosody.ORACLE_SQL, **syllables.ORACLE_SQL, **specs.ORACLE_SQL}
