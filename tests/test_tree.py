import pytest

from tests.conftest import rows_of
from evalspark.sources.tree import (
    MISSING_DESCRIPTION,
    NO_SUBDIRECTORIES,
    TreeError,
    list_directories,
    list_files,
    scan_problems,
    scan_tree,
)


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def node(identifier, body=""):
    return f"---\nid: {identifier}\n---\n{body}"


LEAF = "# User\nhi\n"


@pytest.fixture
def good_tree(tmp_path):
    return write(
        tmp_path / "my tasks+é",
        {
            "cat-b/description.md": node("B"),
            "cat-b/t1/description.md": node("one", LEAF),
            "cat-b/t1/validate.py": "def validate(output): ...",
            "cat-b/t1/files/data.txt": "below a leaf",
            "cat-b/t1/sub/description.md": "# nonsense below a leaf",
            "cat-b/t10/description.md": node("ten", "# System\nbe brief\n" + LEAF),
            "cat/description.md": node("A"),
            "cat/deep/description.md": node("D"),
            "cat/deep/x y/description.md": node("leaf", LEAF),
            "top/description.md": node("top", LEAF),
            "top/validate.py": "async def validate(output): ...",
            ".hidden/description.md": "not read",
            "cat/.git/description.md": "not read",
            "notes.txt": "a file in the root",
        },
    )


def test_tasks_of_a_tree(spark, good_tree):
    tasks = scan_tree(spark, good_tree).collect()
    assert [(t.path[len(good_tree) :], t.id_chain, t.has_validator, len(t.messages)) for t in tasks] == [
        ("/cat/deep/x y", ["A", "D", "leaf"], False, 1),
        ("/cat-b/t1", ["B", "one"], True, 1),
        ("/cat-b/t10", ["B", "ten"], False, 2),
        ("/top", ["top"], True, 1),
    ]
    assert tasks[0].display_name == "A / D / leaf"
    assert len({t.task_id for t in tasks}) == 4


def test_listing(spark, good_tree):
    directories = rows_of(list_directories(list_files(spark, good_tree)))
    assert ("cat-b/t1/files",) in directories and ("cat",) in directories
    assert not [d for (d,) in directories if ".git" in d or "hidden" in d or d == ""]


def test_a_good_tree_has_no_problems(spark, good_tree):
    assert rows_of(scan_problems(spark, good_tree)) == []


@pytest.fixture
def bad_tree(tmp_path):
    return write(
        tmp_path,
        {
            "a/description.md": node("a"),
            "a/missing/leaf/description.md": node("x", LEAF),
            "b/description.md": node("5"),
            "c/description.md": node("c", "# Tool\nx"),
            "d/description.md": node("d"),
            "e/other.txt": "x",
            "ok/description.md": node("ok", LEAF),
            "ok/below/other.txt": "not looked at",
        },
    )


def test_problems_of_a_tree(spark, bad_tree):
    assert rows_of(scan_problems(spark, bad_tree)) == [
        ("a/missing", MISSING_DESCRIPTION),
        ("b", "invalid id"),
        ("c", "unknown header"),
        ("d", NO_SUBDIRECTORIES),
        ("e", MISSING_DESCRIPTION),
    ]


def test_strict_scan_fails_and_lenient_scan_leaves_out(spark, bad_tree):
    with pytest.raises(TreeError, match="missing description"):
        scan_tree(spark, bad_tree)
    assert [t.id_chain for t in scan_tree(spark, bad_tree, strict=False).collect()] == [["ok"]]


def test_a_container_without_subdirectories_is_only_a_warning(spark, tmp_path):
    root = write(tmp_path, {"d/description.md": node("d"), "t/description.md": node("t", LEAF)})
    assert [t.id_chain for t in scan_tree(spark, root).collect()] == [["t"]]
    assert rows_of(scan_problems(spark, root)) == [("d", NO_SUBDIRECTORIES)]


def test_a_validator_file_needs_the_name(spark, tmp_path):
    sources = {
        "a": "from checks import other, validate\n",
        "b": "import re\n\nvalidate = re.compile\n",
        "c": "def validate_all(output): ...\n",
        "d": "class Check:\n    def validate(self, output): ...\n",
        "e": "",
        "f": "x = 1\r\nasync def validate(output): ...\r\n",
        "g": "# def validate(output): ...\nvalidate == 1\n",
    }
    files = {f"{name}/validate.py": text for name, text in sources.items()}
    root = write(tmp_path, files | {f"{name}/description.md": node(name, LEAF) for name in sources})
    found = {t.id_chain[0] for t in scan_tree(spark, root).collect() if t.has_validator}
    assert found == {"a", "b", "f"}


def test_wrong_roots(spark, tmp_path):
    with pytest.raises(TreeError):
        scan_tree(spark, str(tmp_path / "absent"))
    (tmp_path / "file.txt").write_text("x")
    with pytest.raises(TreeError, match="not a directory"):
        scan_tree(spark, str(tmp_path / "file.txt"))


def test_what_a_file_listing_does_not_show(spark, tmp_path):
    """Underscore folders, empty files, directories without files, files that cannot be decoded."""
    root = write(
        tmp_path,
        {
            "_a/description.md": node("A"),
            "_a/_t/description.md": node("t", LEAF),
            "_a/empty/description.md": "",
            "b/description.md": node("b"),
            "c/description.md": node("c", LEAF),
            "c/validate.py": "def validate(output:",
        },
    )
    (tmp_path / "_a" / "bare" / "deeper").mkdir(parents=True)
    (tmp_path / "b" / ".only").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "description.md").write_bytes(b"---\nid: \xff\n---\n")
    (tmp_path / "e" / "description.md").mkdir(parents=True)
    assert rows_of(scan_problems(spark, root)) == [
        ("_a/bare", MISSING_DESCRIPTION),
        ("_a/bare/deeper", MISSING_DESCRIPTION),
        ("_a/empty", "invalid id"),
        ("c", "unreadable validator"),
        ("d", "unreadable description"),
        ("e", "unreadable description"),
        ("e/description.md", MISSING_DESCRIPTION),
    ]
    assert [t.id_chain for t in scan_tree(spark, f"file://{root}", strict=False).collect()] == [["A", "t"], ["c"]]


def test_nothing_below_a_leaf_is_walked(spark, good_tree):
    from evalspark.sources.walk import walk_tree

    walked = {row.directory for row in walk_tree(spark, good_tree).collect()}
    assert walked == {"", "cat", "cat/deep", "cat/deep/x y", "cat-b", "cat-b/t1", "cat-b/t10", "top"}


@pytest.mark.parametrize(
    "source, state",
    [
        ("def validate(o): ...", "found"), ("if True:\n    async def validate(o): ...", "found"),
        ("try:\n    import fast as validate\nexcept ImportError:\n    pass", "found"), ("(other, validate) = 1, 2", "found"),
        ("validate: int", "nameless"), ("x = 'validate'\ndef f():\n    validate = 1", "nameless"), ("import validate.part", "found"),
        ("def validate(", "broken"), ("", "nameless"),
    ],
)
def test_validator_states(source, state):
    from evalspark.sources.walk import validator_state

    assert validator_state(source.encode()) == state
