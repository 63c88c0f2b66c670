import json

import numpy as np
import pytest

from glyphmill import cli
from glyphmill.functions.png import encode_gray
from glyphmill.operators import model
from glyphmill.operators.alphabet import Alphabet
from glyphmill.sources import columns, tarshard


def strip(n):
    img = np.full((40, 20 + n), 235, np.uint8)
    img[10:30, 4 : 10 + n] = 25
    return encode_gray(img)


@pytest.fixture
def corpus(tmp_path):
    """Metadata and images: works 0 to 11, each of five lines; the last two images are missing."""
    pages = tmp_path / "pages" / "00000"
    pages.mkdir(parents=True)
    rows = []
    for i in range(60):
        rows.append({"doc_id": f"line_{i:08d}_v0", "kind": "line", "text": "ᠠᠡ"[: 1 + i % 2] + "b", "src_doc": i // 5, "bucket": "00000", "font": "F", "font_px": 40})
        if i < 58:
            (pages / f"{rows[-1]['doc_id']}.png").write_bytes(strip(i % 7))
    (tmp_path / "meta.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return tmp_path


def test_from_metadata_to_report(spark, corpus, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark).collect()
    got = run("build-alphabet", corpus / "meta.jsonl", "--out", corpus / "alphabet.json", "--counts-out", corpus / "counts.json")
    assert got[0]["kept"] == 3 and Alphabet.load(str(corpus / "alphabet.json")).chars == ("b", "ᠠ", "ᠡ")
    assert run("build-alphabet", corpus / "meta.jsonl", "--out", corpus / "a2.json", "--counts-in", corpus / "counts.json", "--min-count", 40)[0]["dropped"] == 1
    got = run("pack", corpus / "meta.jsonl", "--images", corpus / "pages", "--out", corpus / "tar", "--shard-bytes", 20_000, "--workers", 2)
    assert (got[0]["packed"], got[0]["errors"]) == (58, 2)
    tars = f"{corpus}/tar/*.tar"
    assert tarshard.labelled(tarshard.read(spark, tars)).count() == 58
    split = ("--val", 6, "--test", 9, "--gap", 1)
    assert run("verify", tars, "--alphabet", corpus / "alphabet.json", *split)[0]["ok"]
    with pytest.raises(SystemExit):
        run("verify", tars, "--alphabet", corpus / "alphabet.json", "--val", 50, "--test", 90)
    got = {r["split"]: r["n_docs"] for r in run("extract", tars, "--out", corpus / "splits", "--per-shard", 4, *split)}
    assert got == {"train": 5, "val": 2, "test": 3, "gap": 2}
    assert tarshard.read(spark, f"{corpus}/splits/val/*.tar").count() == 10
    with pytest.raises(SystemExit):
        run("extract", tars, "--out", corpus / "no", "--val", 0, "--test", 9, "--gap", 1)
    got = run("build-columns", tars, "--out", corpus / "columns", "--split", "test", "--columns", 6, "--lines-min", 3, "--lines-max", 4, "--line-gap", 5, *split)
    assert got[0]["columns"] == 6 and 3 <= got[0]["min_lines"] <= got[0]["max_lines"] <= 4
    assert columns.read_columns(spark, str(corpus / "columns")).count() == 6
    np.savez(corpus / "w.npz", alphabet=np.array(["b", "ᠠ", "ᠡ"]), mode="mean", **model.init(4, 4))
    net = ("--weights", corpus / "w.npz", "--alphabet", corpus / "alphabet.json", "--img-h", 32)
    got = run("eval", tars, "--split", "test", "--out", corpus / "pred", *net, *split)
    assert got[0]["n"] == 13
    assert run("eval", tars, "--split", "test", "--max-batches", 2, "--batch-size", 3, "--show", 2, *net, *split)[0]["n"] == 6
    assert "median" not in capsys.readouterr().out
    assert run("verify", tars, "--alphabet", corpus / "alphabet.json", "--window", 58, *split)[0]["ok"]
    assert run("report", corpus / "pred", "--by", "font")[0]["n"] == 13 and len(run("report", corpus / "pred", "--pairs")) == 2
    assert run("eval-columns", corpus / "columns", "--tile", 60, "--window", 20, "--least", 20, *net)[0]["n"] == 6
    out = capsys.readouterr().out
    assert "median" in out and "n_tiles" in out and "height" in out
    (corpus / "corpus.jsonl").write_text(json.dumps({"text": "word " * 20}) + "\n{torn\n")
    assert run("lines", corpus / "corpus.jsonl", "--out", corpus / "lines")[0]["lines"] == 4
    got = run("plan-lines", corpus / "corpus.jsonl", "--out", corpus / "tasks", "--variants", 3, "--max-lines", 3)
    assert (got[0]["tasks"], got[0]["documents"]) == (9, 1)
    got = run("plan-pages", corpus / "corpus.jsonl", "--out", corpus / "pages", "--lines-min", 1, "--lines-max", 2, "--max-pages", 2)
    assert got[0]["pages"] == 2 and 2 <= got[0]["lines"] <= 4
