"""The entry keeps the core queries whatever the corpus operators lack."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counted(block: str) -> tuple[int, int]:
    code = f"import sys; {block}import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    queries, sql = out.split()
    return int(queries), int(sql)


def test_core_queries_without_a_dependency_of_the_corpus_operators():
    for module in ("sentencepiece", "public_tokenizers", "tabloom.llm", "corpus_pipeline"):
        queries, sql = counted(f"sys.modules['{module}'] = None; ")
        assert queries >= 183 and sql >= 173
