import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_nothing_outside_llm_imports_it():
    import subprocess

    found = subprocess.run(["grep", "-rlE", "tidemill.llm|from \\.+llm", "tidemill", "--include=*.py", "--exclude-dir=llm"], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert found.stdout == ""
