"""After each micro-batch of changes, the snapshot equals a fresh scan."""

import json

from corvane.plans.workspace import Workspace
from corvane.streaming import changes
from corvane.streaming.live import LiveWorkspace


def facts(diagnostics):
    return sorted((r["file"], r["code"], r["message"], r["range"]["start"]["line"]) for r in diagnostics.collect())


def test_snapshots_equal_fresh_scans(spark, tmp_path):
    tree, feed = tmp_path / "tree", tmp_path / "feed"
    tree.mkdir()
    feed.mkdir()
    live = LiveWorkspace(spark, str(tree), f"file://{tmp_path}/live")
    steps = [
        {"requirements.txt": "", "lib.py": "def f(a): pass\n", "use.py": "f(1)\nimport nowhere\n"},
        {"lib.py": "def f(a, b): pass\n"},  # a changed definition makes a call in another file wrong
        {"requirements.txt": "nowhere\n"},  # a changed manifest makes an import right
        {"lib.py": None},  # a removed file takes its definition along
    ]
    seq, seen = 0, []
    for k, files in enumerate(steps):
        records = []
        for name, text in files.items():
            (tree / name).unlink() if text is None else (tree / name).write_text(text)
            seq += 1
            kind = "remove" if text is None else "modify"
            records.append({"seq": seq, "path": name if name.endswith(".py") else "lib.py", "kind": kind, "ts": "2024-01-01T00:00:00Z"})
        (feed / f"{k}.json").write_text("\n".join(map(json.dumps, records)))
        live.follow(changes.feed(spark, str(feed)), {"availableNow": True}).awaitTermination(180)
        fresh = Workspace.scan(spark, str(tree))
        assert facts(live.latest("diagnostics")) == facts(fresh.all_diagnostics()), k
        assert sorted((r["file"], r["composite"]) for r in live.latest("health").collect()) == sorted((r["file"], r["composite"]) for r in fresh.health().collect())
        seen.append(sorted(r["file"] for r in live.latest("events").filter("type = 'diagnosticsUpdated'").collect()))
    assert seen == [["use.py"], ["use.py"], ["use.py"], ["use.py"]]
    assert len(live.batches()) == 4
    assert live.silver.known().count() == 3  # each content was parsed once
    live.rebuild(batch_id=live.batches()[-1])  # a repeated batch replaces its own
    assert len(live.batches()) == 4
