"""What the text operators must not contain; broadcasts and collects there are of bounded data."""

import pathlib
import re

import jobtrail.llm

NATIVE = ("quality_rules.py", "url_filter.py")


def test_no_unbounded_tools():
    for path in pathlib.Path(jobtrail.llm.__file__).parent.glob("*.py"):
        text = path.read_text()
        assert not re.search(r"toPandas|localCheckpoint|crossJoin|\.rdd\b|\.cache\(\)|F\.broadcast\(", text), path
        if path.name in NATIVE:
            assert not re.search(r"mapIn|applyIn|pandas|pyarrow|udf", text), path
