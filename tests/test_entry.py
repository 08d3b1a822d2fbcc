import __spark_entry__
from labelgrow.oracles import oracle_sql
from labelgrow.queries import queries


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "pseudo_label", "prob", "iteration"]
    assert set(oracle_sql()) <= set(queries()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_folder():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "labelgrow"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
