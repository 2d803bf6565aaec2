"""The entry without what only the text operators need."""

import subprocess
import sys

import pytest
from conftest import ROOT

CODE = """
import sys
for name in {missing!r}.split():
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), sum(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""


@pytest.mark.parametrize("missing", ["corpus_pipeline dwitable.llm", "zstandard", "xxhash", "tokenizers", "public_tokenizers"])
def test_other_queries_stay(missing):
    out = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, check=True)
    queries, with_sql, of_texts = map(int, out.stdout.split())
    assert queries - of_texts >= 160 and with_sql >= queries - of_texts and (of_texts == 0 or missing == "tokenizers")
