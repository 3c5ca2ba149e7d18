import subprocess
import sys


def test_the_entry_works_without_the_training_data_operators():
    code = "import sys; sys.modules['condensa.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'top_concepts' in q and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
