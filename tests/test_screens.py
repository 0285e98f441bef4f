from pathloom.sources import screens


def test_index_and_assets_of_episode_folders(spark, tmp_path):
    for path in ("u1/20300101_000000/action.jsonl", "u1/20300101_000000/Screenshots_1/9.png", "u1/20300101_000000/Screenshots_1/12.png", "u1/20300101_000000/Screenshots_1/tree_12.xml", "u2/20300101_000000/action.jsonl", "u2/20300102_000000/notes.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    files = screens.listing(spark, str(tmp_path))
    index = {(r.part, r.time): r.folder.split("/")[-2] for r in screens.episode_index(files, str(tmp_path)).collect()}
    assert index == {("u1", "20300101_000000"): "u1", ("u2", "20300101_000000"): "u2", ("20300101_000000", "20300101_000000"): "u1"}
    own = {(r.user_id, r.time): r for r in screens.assets(files).collect()}
    first = own["u1", "20300101_000000"]
    assert [p.rsplit("/", 1)[-1] for p in first.screenshots] == ["9.png", "12.png"] and [p.rsplit("/", 1)[-1] for p in first.trees] == ["tree_12.xml"]
    assert own["u2", "20300102_000000"].screenshots == []
