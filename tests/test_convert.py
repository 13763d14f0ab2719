"""Raw files of two public layouts to sessions and questions, against a plain reading of the same JSON."""

import json
import re

import pytest

from threadloom.sources import convert
from threadloom.sources.corpus import NO_ANSWER

GROUPS = [
    {
        "conversation": {
            "speaker_a": "Ann", "session_2": [], "session_1": [{"speaker": "Ann", "text": "hi"}, {"speaker": "Bob", "text": "yo", "blip_caption": "a cat"}, {"speaker": "Ann", "text": 5}], "session_1_date_time": "1:56 pm on 8 May, 2023",
            "session_2_date_time": "9 am on 12 sept 2023", "session_4": [{"speaker": "Ann", "text": "lost"}], "session_03": [{"text": "no"}], "session_10_date_time": "x", "session_3_summary": "y",
        },
        "qa": [{"question": "who?", "answer": "Ann", "evidence": ["D1:3", "D1:4", "D10:1", "D"], "category": 2}, {"question": "when?", "answer": 2022, "evidence": [], "category": "4"}, {"question": "none?", "category": 5}, {"question": "zero?", "answer": 0}, {"question": "yes?", "answer": True}, {"question": "empty?", "answer": ""}, {"question": "0?", "answer": "0"}],
    },
    {"conversation": {f"session_{k}": [{"speaker": "Cid", "text": f"t{k}"}] for k in (10, 2, 1, 3, 4, 5, 6, 7, 8, 9)}, "qa": []},
    {"other": 1},
]
STACKS = [
    {"question": "q", "answer": 3, "question_type": "multi-session", "question_date": "2023/05/30 (Tue) 10:00", "answer_session_ids": ["a", "b"], "haystack_session_ids": ["a", "b", "c"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "May", "2023/05/22"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}, {"role": "assistant", "content": None}], None]},
    {"question": "r", "answer": "yes", "question_type": "odd", "answer_session_ids": "z"},
]


def scan_sessions(groups):
    out = []
    for item, g in enumerate(groups):
        c, k = g.get("conversation", {}), 1
        while f"session_{k}" in c:
            m = re.search(r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})", c.get(f"session_{k}_date_time", ""))
            month = "" if not m else {"may": "05", "sept": "09"}[m[2].lower()]
            said = "".join(f'"{x.get("speaker", "")}": "{x["text"]}' + (f' (attached is {x["blip_caption"]})' if x.get("blip_caption") else "") + '"' for x in c[f"session_{k}"])
            out.append((item, k, f"D{k}", f"{m[3]}/{month}/{m[1].zfill(2)}" if m else c.get(f"session_{k}_date_time", ""), said))
            k += 1
    return out


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("array", [True, False])
def test_groups(spark, tmp_path, array):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps(GROUPS, indent=1) if array else "\n".join(map(json.dumps, GROUPS)))
    items = convert.read_items(spark, str(path))
    assert rows(items.select("item")) == [(0,), (1,), (2,)]
    assert rows(convert.group_sessions(items)) == scan_sessions(GROUPS)
    asked = [tuple(r) for r in convert.group_questions(items).orderBy("item", "number").collect()]
    assert [(a[0], a[1], a[2]) for a in asked] == [(0, k, q["question"]) for k, q in enumerate(GROUPS[0]["qa"])]
    assert [a[3] for a in asked] == ["Ann", "2022", NO_ANSWER, NO_ANSWER, "True", NO_ANSWER, "0"]
    assert [a[4] for a in asked] == ["2", "4", "5", "", "", "", ""] and [a[5] for a in asked][:3] == [["D1", "D10"], [], []]
    assert convert.group_questions(items, two_letters=True).first()["origin"] == ["D1"]


def test_haystacks(spark, tmp_path):
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, STACKS)))
    items = convert.read_items(spark, str(tmp_path / "raw.json"))
    assert rows(convert.haystack_sessions(items)) == [(0, 0, "a", "2023/05/20", '"user": "x""assistant": ""'), (0, 1, "b", "", "")]
    assert rows(convert.haystack_questions(items)) == [(0, 0, "q", "3", "multi-session", "2023/05/30 (Tue) 10:00", ["a", "b"], "3"), (1, 0, "r", "yes", "odd", "", ["z"], "yes")]


def test_files_in_and_out(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"in{k}.json").write_text(json.dumps(GROUPS[:2]))
    out = str(tmp_path / "out")
    convert.convert(spark, str(tmp_path / "in*.json"), out, "groups")
    assert convert.next_item(spark, out) == 6  # an item without questions counts too
    (tmp_path / "more.json").write_text(json.dumps(STACKS[0]))
    convert.convert(spark, str(tmp_path / "more.json"), out, "haystacks", json_array=False, route=True)
    back = spark.read.json(f"{out}/sessions")
    assert {r["item"]: r["count"] for r in back.groupBy("item").count().collect()} == {0: 2, 1: 10, 2: 2, 3: 10, 4: 2, 5: 10, 6: 2}
    assert [json.loads(line)["session_id"] for p in (tmp_path / "out/sessions/item=1").glob("part*") for line in p.read_text().splitlines()] == [f"D{k}" for k in range(1, 11)]
    with pytest.raises(ValueError):
        convert.convert(spark, out, out, "other")
