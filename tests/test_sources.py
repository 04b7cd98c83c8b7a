import json

from pyspark.sql import functions as F

from quernel.functions.register import register
from quernel.functions.text import folder_file_name
from quernel.operators import catalog
from quernel.sources import export, rdf, skills
from quernel.sources.json_files import write_files

BODY = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e/o/"><owl:Ontology rdf:about="http://e/o/"/>{}</rdf:RDF>'


def tree(path):
    for name, iris in {"BE/A": ["x", "shared"], "BE/Corp/B": ["y", "shared"], "LOAN/C": ["shared"]}.items():
        target = path / f"{name}.rdf"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(BODY.format("".join(f'<owl:Class rdf:about="http://e/o/{i}"/>' for i in iris) + '<owl:ObjectProperty rdf:about="http://e/o/p"><rdfs:domain rdf:resource="http://e/o/x"/></owl:ObjectProperty>'))
    (path / "MetadataX.rdf").write_text("-")


def test_export_and_merge(spark, tmp_path):
    tree(tmp_path / "in")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "kept.txt").write_text("of another run")
    report = export.export_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (report["exportedCount"], report["skippedCount"]) == (3, 1) and [r["path"] for r in report["skipped"].collect()] == [str(tmp_path / "in" / "MetadataX.rdf")]
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert sorted(found) == ["BE/A.ontology.json", "BE/Corp/B.ontology.json", "LOAN/C.ontology.json", "kept.txt"]  # nothing is left of the staging
    assert sorted(r["output"] for r in report["exported"].collect()) == sorted(str(tmp_path / "out" / n) for n in found if n != "kept.txt")
    document = json.loads(found["BE/A.ontology.json"])
    assert found["BE/A.ontology.json"] == json.dumps(document, ensure_ascii=False, indent=2)
    assert list(document) == ["file", "ontologyBase", "summary", "imports", "classes", "edges", "attributes"] and document["file"] == str(tmp_path / "in" / "BE" / "A.rdf")
    assert [c["iri"] for c in document["classes"]] == ["http://e/o/shared", "http://e/o/x"] and document["attributes"] == [] and document["edges"][0]["technicalName"] == "e:p"
    assert list(document["classes"][0]) == export.CLASS and document["classes"][0]["label"] is None and document["summary"] == {"nodes": 2, "edges": 1, "properties": 0, "triples": 5}
    tables = rdf.ontology(rdf.read_xml(rdf.scan_files(spark, str(tmp_path / "in"))))

    place = F.regexp_extract("file", r"/in/(.*)/([^/]+)\.rdf$", 1).alias("folder")
    name = F.regexp_extract("file", r"/in/(.*)/([^/]+)\.rdf$", 2).alias("file_name")
    items = lambda t: t.select("*", place, name).drop("file").withColumnRenamed("file_name", "file").withColumn("pos", F.col("iri"))
    merged = {r["sourceDir"]: r for r in export.folder_documents(items(tables["classes"]), items(tables["properties"])).collect()}
    assert {k: (r["summary"]["classes"], r["summary"]["edges"], r["summary"]["sourceFiles"]) for k, r in merged.items()} == {"": (3, 1, 3), "BE": (3, 1, 2), "BE/Corp": (2, 1, 1), "LOAN": (1, 1, 1)}
    assert merged["BE"]["fileName"] == "all_be.ontology.json" and merged[""]["fileName"] == "all.ontology.json"


def test_folder_names(spark):
    names = {"GovernmentEntities": "all_government_entities.ontology.json", "FND": "all_fnd.ontology.json", "nested": "all_nested.ontology.json", "ABC1": "all_1.ontology.json", "A_B c": "all_b_c.ontology.json", "__": "all___.ontology.json", "FNDLoans2Go": "all_fnd_loans_2_go.ontology.json"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", folder_file_name(F.col("n")).alias("f")).collect()
    assert {r["n"]: r["f"] for r in rows} == names


def test_ontology_documents_are_read_back(spark, tmp_path):
    item = {"name": "n", "technicalName": "e:n", "iri": "i", "parents": [], "rules": [{"property": "p", "operator": "some", "value": "v", "qualifier": None}]}
    edge = {"kind": "edge", "name": "p", "technicalName": "e:p", "domain": ["n"], "range": ["n"]}
    (tmp_path / "a.ontology.json").write_text(json.dumps({"file": "a", "classes": [item], "edges": [edge], "attributes": []}, indent=1))
    (tmp_path / "all_x.ontology.json").write_text(json.dumps({"sourceDir": "x", "classes": []}))
    classes, properties = catalog.explode_items(catalog.read_ontologies(spark, str(tmp_path)))
    assert [(r["technical_name"], r["rules"][0]["operator"]) for r in classes.collect()] == [("e:n", "some")]
    assert [tuple(r) for r in catalog.properties_of_classes(classes, properties).collect()] == [("e:n", "edge", "e:p")]
    assert catalog.read_ontologies(spark, str(tmp_path), generated=True).count() == 1


def test_skills(spark, tmp_path):
    for code, text in {"b": "---\nname: Beta\ndescription: \"does b\"\n---\nbody", "a": "---\nname: Alpha\n---\n", "c": "no front matter"}.items():
        (tmp_path / code).mkdir()
        (tmp_path / code / "SKILL.md").write_text(text)
    table = skills.read_skills(spark, str(tmp_path))
    assert skills.catalog_text(table).first()["catalog"] == "- /a (Alpha): \n- /b (Beta): does b"


def test_sql_names(spark):
    assert "normalize_text" in register(spark)
    assert spark.sql("SELECT normalize_text('Đà  Nẵng') AS x").first()["x"] == "da nang"


def test_restrictions_at_any_depth(spark):
    depth = 67
    rows = [("f", 0, "http://e/o/x", "iri", rdf.RDFS + "subClassOf", "b0", "bnode", None, None)]
    rows += [("f", i + 1, f"b{i}", "bnode", rdf.OWL + "unionOf", f"b{i + 1}", "bnode", None, None) for i in range(depth)]
    assert rdf.restrictions(spark.createDataFrame(rows, rdf.TRIPLE)).count() == depth + 1


def merged_brute(root):
    """Merge folders from the bottom up, with the files that each step has written."""
    import re

    folders = {p.parent for p in root.rglob("*.ontology.json")}
    folders |= {q for p in folders for q in p.parents if q == root or root in q.parents}
    written = {}
    for folder in sorted(folders, key=lambda p: len(p.parts), reverse=True):
        files = [(p, json.loads(p.read_text())) for p in sorted(folder.glob("*.ontology.json"))]
        files += [(q, written[q]) for child in sorted(p for p in folder.iterdir() if p.is_dir()) for q in written if q.parent == child]
        out = {"sourceDir": str(folder), "sourceFiles": [str(p) for p, _ in files], "summary": {"sourceFiles": len(files)}, "classes": [], "edges": [], "attributes": []}
        for kind in ("classes", "edges", "attributes"):
            seen = set()
            for _, document in files:
                for item in document.get(kind, []):
                    key = next(((k, item[k]) for k in ("iri", "technicalName", "name") if item.get(k)), None)
                    if key is None or key not in seen:
                        seen.add(key)
                        out[kind].append(item)
            out["summary"][kind] = len(out[kind])
        words = re.findall(r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|\d+", folder.name)
        written[folder / ("all.ontology.json" if folder == root else f"all_{'_'.join(words).lower()}.ontology.json")] = out
    return written


def test_folder_files(spark, tmp_path):
    root = tmp_path / "root"
    trees = {
        "Fruit/AllFruit": [{"iri": "fruit"}, {"iri": "shared", "from": "fruit"}], "Fruit/Berries/Berries": [{"iri": "berry"}, {"iri": "shared", "from": "berry"}],
        "Fruit/Berries/Wild/WildBerry": [{"iri": "nested"}, {"name": "no iri"}, {"x": 1}, {"x": 1}], "VEG/AllVEG": [{"iri": "veg"}, {"iri": "shared"}, {"name": "no iri", "ö": [1.5, None, {"b": "€"}]}],
        "Fruit/Zed A": [{"iri": "z", "technicalName": "t"}, {"iri": "", "technicalName": "t"}], "Top": [{"iri": "top"}, {"iri": "nested", "late": True}],
    }
    for name, classes in trees.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.ontology.json").write_text(json.dumps({"classes": classes, "edges": [{"technicalName": name}], "attributes": []}))
    expected = merged_brute(root)
    (root / "Fruit" / "all_fruit.ontology.json").write_text(json.dumps({"classes": [{"iri": "stale"}]}))  # generated before, and written again
    report = {r["output"]: r["summary"].asDict() for r in export.merge_folder_files(spark, str(root)).collect()}
    assert report == {str(p): d["summary"] for p, d in expected.items()}
    for path, document in expected.items():
        assert path.read_text() == json.dumps(document, ensure_ascii=False, indent=2)
    assert not list(root.rglob(".staging*"))


def test_nothing_is_written_by_a_run_that_fails(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a.json", "value", "x", "1", 0), (f"{tmp_path}/b.json", "item", "x", "1", 0)], "path string, kind string, field string, json string, at int")
    import pytest

    with pytest.raises(Exception, match="without its array"):
        write_files(rows, str(tmp_path), ["at"])
    assert list(tmp_path.iterdir()) == []


def test_a_document_of_many_items_is_streamed(spark, tmp_path):
    items = spark.range(30_000).selectExpr(f"'{tmp_path}/big.json' AS path", "'item' AS kind", "'items' AS field", "to_json(struct(id)) AS json", "1 AS at", "id AS ord")
    start = spark.createDataFrame([(f"{tmp_path}/big.json", "array", "items", None, 0, 0), (f"{tmp_path}/empty.json", "array", "items", None, 0, 0)], items.schema)
    write_files(items.unionByName(start), str(tmp_path), ["at", "ord"])
    assert [i["id"] for i in json.loads((tmp_path / "big.json").read_text())["items"]] == list(range(30_000))
    assert (tmp_path / "empty.json").read_text() == json.dumps({"items": []}, indent=2)


def test_the_driver_hears_of_folders_instead_of_files(spark, tmp_path, monkeypatch):
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa

    from quernel.sources import json_files

    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3, taskAttemptId=lambda: 8))
    monkeypatch.setattr(json_files, "TaskContext", task)
    rows = [SimpleNamespace(path=f"{tmp_path}/out/{n % 7}/á\n{n}.txt", kind="text", field="", json=f"text {n}") for n in range(500)]
    message = json_files.JsonFilesWriter(f"{tmp_path}/staging").write(rows)
    assert len(pickle.dumps(message)) < 500  # not a name for each file
    batch = pa.RecordBatch.from_arrays([pa.array([0])], ["id"])
    move = json_files._move(f"{tmp_path}/staging", [message.attempt])
    for _ in range(2):  # a lost task is repeated
        assert [b.column(0).to_pylist() for b in move([batch])] == [[500]]
    assert {str(p): p.read_text() for p in (tmp_path / "out").rglob("*.txt")} == {r.path: r.json for r in rows}
    (tmp_path / "out" / "0" / "á\n0.txt").unlink()
    import pytest

    with pytest.raises(OSError):  # neither staged nor in its place
        list(move([batch]))


def test_folders_are_read_in_tasks(spark, tmp_path):
    from quernel.sources.json_files import read_folders

    for n in range(30):
        (tmp_path / str(n % 3)).mkdir(exist_ok=True)
        (tmp_path / str(n % 3) / f"{n}").write_bytes(bytes([255, n]) * n)
    (tmp_path / "0" / "below").mkdir()
    folders = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in range(3)], "folder string")
    assert {r["path"]: bytes(r["content"]) for r in read_folders(folders).collect()} == {f"{tmp_path}/{n % 3}/{n}": bytes([255, n]) * n for n in range(30)}
