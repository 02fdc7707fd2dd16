import pytest

from siltstone.config import Settings
from siltstone.operators import documents
from siltstone.plans.engine import Engine


def test_engine(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "fees.txt").write_text("The tuition fee is due in May. Payment by bank is accepted for every course.")
    (source / "copy.txt").write_text("The tuition fee is due in May. Payment by bank is accepted for every course.")
    (source / "library.md").write_text("# Library\nThe library opens at eight. Books are lent for two weeks.")
    (source / "bad.json").write_text("{")
    engine = Engine(spark, str(tmp_path / "corpus"), Settings(chunk_size=200, chunk_overlap=20, dimensions=64))
    processed = {r.file_name: r for r in engine.process_folder(str(source)).collect()}
    assert processed["fees.txt"].num_chunks == 1 and len(processed) == 4
    merged = engine.table("deduplicated").where("merged").collect()
    assert len(merged) == 1 and merged[0].merge_count == 2
    top = engine.search("when is the tuition fee due", 2).collect()
    assert "tuition" in top[0].text and top[0].reranked
    answer = engine.answer("when does the library open").first()
    assert "library" in answer.response and answer.intent_type
    assert engine.answer("hello").first().response.startswith("Hello")
    assert engine.multi_search("tuition fee", 3).count() >= 2
    doc = engine.table("documents").where("file_name = 'library.md'").first().doc_id
    engine.delete_document(doc)
    assert engine.table("index").where(f"doc_id = '{doc}'").count() == 0


def test_settings():
    assert Settings.preset("research").chunk_size == 1200
    assert [k for k, _ in Settings(chunk_size=50, chunk_overlap=60, similarity_threshold=0.2).problems()] == ["error", "warning", "warning"]
    with pytest.raises(ValueError):
        Engine(None, "x", Settings(chunk_size=10, chunk_overlap=20))


def test_index(spark, tmp_path):
    assert documents.load(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "q")
    documents.evaluation_template(spark).coalesce(1).write.option("header", True).csv(path)
    assert sorted(documents.evaluation_questions(spark, path).first().expected_answer_contains)


def test_entry_without_the_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 40, said.stderr
