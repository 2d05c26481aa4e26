import json

import pytest

from docsift.cli import main
from tests import fixtures as fx

NAME = "20260315_Tove HARKNESS_Yard Master"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    for name in (NAME, "20250101_Tove HARKNESS_Older", "CV final"):
        folder = root / name
        folder.mkdir()
        (folder / f"{name}.docx").write_bytes(fx.canonical_docx())
    folder = root / NAME
    (folder / f"{NAME}.pdf").write_bytes(fx.text_pdf(fx.canonical_text()))
    (folder / f"{NAME}_Design.pdf").write_bytes(fx.pages_pdf([fx.content_of(fx.TWO_COLUMNS)]))
    (root / "jd.txt").write_text(fx.JD)
    (root / "cv.pdf").write_bytes(fx.pages_pdf([fx.content_of(fx.TWO_COLUMNS)]))
    (root / "bad.docx").write_bytes(b"no zip")
    return root


def run(spark, capsys, *args):
    code = main([str(a) for a in args], spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_folder_and_latest(spark, capsys, root):
    code, out, _ = run(spark, capsys, "validate", root / NAME, "--json")
    data = json.loads(out)
    assert code == 0 and data["filename"] == f"{NAME}.docx" and data["validation"]["passed"] and data["validation"]["score"] == 100
    assert {"archive.folder_name", "archive.files", "archive.extra_files"} <= {c["id"] for c in data["validation"]["checks"]}
    code, out, _ = run(spark, capsys, "validate", "--latest", "--archive-root", root)
    assert code == 0 and NAME in out
    assert run(spark, capsys, "validate", root / "CV final")[0] == 1


def test_could_not_run(spark, capsys, root):
    for args, said in ((["validate", "--latest", "--archive-root", root / "none"], "pass the files directly"), (["validate", root / "bad.docx"], "not a DOCX"), (["review", root / "none.pdf"], "not a file"), (["validate"], "name a folder")):
        code, _, err = run(spark, capsys, *args)
        assert code == 2 and said in err


def test_review(spark, capsys, root):
    code, out, _ = run(spark, capsys, "review", root / "cv.pdf", "--jd", root / "jd.txt")
    assert code == 0 and out.startswith("# ATS parse report") and "Job description overlap" in out
    assert "EMPLOYMENT KEY SKILLS" not in run(spark, capsys, "review", root / "cv.pdf", "--text-only")[1]
    assert "EMPLOYMENT KEY SKILLS" in run(spark, capsys, "review", root / "cv.pdf", "--text-only", "--stream-order")[1]
    assert "parseability" in json.loads(run(spark, capsys, "review", root / "cv.pdf", "--json")[1])
