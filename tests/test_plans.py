"""The rewrite, track lists, settings, sources and the stream, end to end."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from cueloom.functions.text import BLANK
from cueloom.operators.pacing import paced
from cueloom.plans import languages, settings, tracklist
from cueloom.plans.rewrite import paced_parts, parsed, rewrite
from cueloom.plans.settings import Settings
from cueloom.sources import protobuf, srv3, store, xml_tree
from cueloom.sources.translators import batches_of, translated_track
from cueloom.streaming.rewrite import read_stream, rewrite_stream

HEAD = '<?xml version="1.0"?><timedtext format="3"><head><wp id="1" ap="6" rc="1"/></head><body>'
ASR, PLAIN = "https://www.youtube.com/api/timedtext?kind=asr", "https://www.youtube.com/api/timedtext?v=1"


def docs(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "track_id string, url string, body string")


def one(spark, url, inner, head=HEAD, **options):
    return rewrite(docs(spark, (url, head + inner + "</body></timedtext>")), **options).first()


def test_segments_keep_their_spaces(spark):
    r = one(spark, PLAIN, '<p t="22160" d="5960" wp="1"><s>Make</s><s t="80"> way,</s><s> the beast has returned.</s></p>', translate=lambda t: ["甲&乙"] * len(t))
    assert "<s>Make way, the beast has returned.&#x000A;甲&amp;乙</s>" in r.body and r.body.count("<s>") == 1 and 'rc="2"' in r.body
    assert r.caption_mode == "official" and r.cues == 1


def test_roll_up_is_broadcast_by_structure(spark):
    inner = '<w t="0" id="1"/><p t="40" d="4200" w="1">A &amp; B</p><p t="4230" w="1" a="1"></p><p t="4240" d="4200" w="1">two</p>'
    r = one(spark, PLAIN, inner)
    assert r.caption_mode == "broadcast" and '<p t="40" d="4190">A &amp; B&#x000A;A &amp; B</p>' in r.body and "<w" not in r.body.replace("<wp", "")
    assert one(spark, PLAIN + "&name=CC2", '<p t="0" d="1">x</p>').caption_mode == "broadcast"


def test_automatic_cue_is_cut(spark):
    r = one(spark, ASR, '<p t="1000" d="9000">This is a very long automatic caption, and it should be divided at a natural boundary before it overlaps.</p><p t="8500" d="2000">Next caption.</p>')
    assert r.cues == 4 and [f't="{t}" d="{d}"' in r.body for t, d in ((1000, 2767), (3767, 2694), (6461, 2039), (8500, 2000))] == [True] * 4


def test_other_bodies_pass_through(spark):
    got = rewrite(docs(spark, (PLAIN, "<html/>"), (PLAIN, "<timedtext><body>"), (PLAIN, None), (PLAIN, ""))).orderBy("track_id").collect()
    assert [r.body for r in got] == ["<html/>", "<timedtext><body>", None, ""]
    assert [r.caption_mode for r in got] == [None, "official", None, None] and [r.headers is None for r in got] == [True, False, True, True]


def test_row_method_and_positions(spark):
    assert "x&#x000A;X" in one(spark, PLAIN, '<p t="0" d="1">x</p>', settings=Settings(method="Row")).body
    head = HEAD.replace('id="1"', 'id="3" ') .replace("</head>", '<wp id="4" rc="5"/></head>')
    r = one(spark, PLAIN, '<p t="0" d="1">x</p>', head=head)
    assert '<wp id="3"  ap="6" rc="1"/><wp id="4" rc="5"/>' in r.body
    assert "<wp id='1' rc=\"2\"/>" in one(spark, PLAIN, '<p t="0" d="1">x</p>', head="<timedtext><head><wp id='1'/></head><body>").body


@pytest.mark.parametrize(("n", "text", "batches"), [(231, "자동 생성 자막 {}: 화면 문장입니다.", 15)])
def test_batches_of_automatic_captions(spark, n, text, batches):
    inner = "".join(f'<p t="{i * 2000}" d="1900">{text.format(i + 1)}</p>' for i in range(n))
    parts = paced_parts(parsed(docs(spark, (ASR, HEAD + inner + "</body></timedtext>")))).first()._parts
    assert len(parts) == n and len(batches_of("automatic", [p.text for p in parts], Settings())) == batches


def test_official_batches():
    assert [len(b) for b in batches_of("official", [f"line {i}" for i in range(121)], Settings())] == [120, 1]


def test_everything_else_in_a_document_stays(spark):
    head = '<?xml version="1.0"?><!-- <p t="9">no</p> --><timedtext format="3" new="1"><head><pen id="1" fc="#FFF"/><ws id="0"/><wp id="0" zz="1"/><wp id="1" rc="1" q="7"/></head><body extra="e">'
    inner = '<p t="0" d="10" p="1" k="a&amp;b">hello<br/>there</p><!-- between --><p t=5 d=\'7\' bare><s p="1">a</s><s t="3"> b&#33;</s><i>x</i></P><p t="9"><![CDATA[hidden]]></p><p t="11"/><q/>'
    r = one(spark, PLAIN, inner, head=head)
    assert r.body.startswith(head.replace('rc="1"', 'rc="2"')) and r.cues == 4
    assert '<p t="0" d="10" p="1" k="a&amp;b">hellothere&#x000A;HELLOTHERE<br/></p><!-- between --><p t="5" d="7" bare=""><s>a b!&#x000A;A B!</s><i>x</i></p>' in r.body
    assert '<p t="9"><![CDATA[hidden]]></p><p t="11"></p><q/></body></timedtext>' in r.body


def test_rows_need_no_ids(spark):
    body = HEAD + '<p t="0" d="1">{}</p></body></timedtext>'
    df = spark.createDataFrame([("a", PLAIN, body.format("x")), ("a", PLAIN, body.format("y")), (None, PLAIN, body.format("z")), (None, None, body.format("w"))], "track_id string, url string, body string")
    got = sorted((r.body, r.track_id, r.cues) for r in rewrite(df).collect())
    assert [(g[1], g[2]) for g in got] == [(None, 1), ("a", 1), ("a", 1), (None, 1)]
    assert all(f"{x}&#x000A;{x.upper()}" in g[0] for x, g in zip("wxyz", got, strict=True))


def test_failing_translator_leaves_the_document(spark):
    def fails(texts):
        if any("bad" in t for t in texts):
            raise OSError
        return texts

    bodies = [HEAD + f'<p t="0" d="1">{t}</p></body></timedtext>' for t in ("bad", "good")]
    got = rewrite(docs(spark, *((PLAIN, b) for b in bodies)), fails, Settings(retries=1, wait_s=0.0)).orderBy("track_id").collect()
    assert got[0].body == bodies[0] and got[0].caption_mode is None and "good&#x000A;good" in got[1].body


def test_headers(spark):
    r = one(spark, ASR, '<p t="0" d="1">x</p>')
    assert r.headers == {"X-Captions-Version": "23", "X-Captions-Settings": "standalone", "X-Captions-ASR-Mode": "fixed-two-lines-split-long-cues", "X-Captions-Broadcast-Mode": "unchanged", "X-Captions-Caption-Mode": "automatic", "X-Captions-XML-Original-Length": str(r.original_len), "X-Captions-XML-Modified-Length": str(len(r.body))}


def test_rewrite_is_one_pass(spark):
    plan = rewrite(docs(spark, (PLAIN, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" not in plan


def test_scheduler_and_fallback():
    running, most = [0], [0]
    lock = threading.Lock()

    def watched(texts):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(60)]
    want = [t.upper() for t in texts]
    assert translated_track("official", texts, watched, Settings(batch_rows=2, queue_over=24, concurrency=3)) == want and most[0] <= 3
    most[0] = 0
    assert translated_track("official", texts, watched, Settings(batch_rows=10, queue_over=24, concurrency=1)) == want and most[0] > 1
    calls = []
    nested = lambda t: calls.append(len(t)) or ([["只有一条"]] if len(t) > 1 else ["逐行"])
    assert translated_track("official", ["a", "b", "c"], nested, Settings()) == ["逐行"] * 3 and calls[0] == 3
    waits = []
    flaky = iter([OSError(), OSError(), None])

    def twice(t):
        if e := next(flaky):
            raise e
        return t

    assert translated_track("official", ["a"], twice, Settings(wait_s=0.25), sleep=waits.append) == ["a"] and waits == [0.25, 0.5]
    assert translated_track("official", [], watched, Settings()) == []


def test_pacing_by_mode():
    long = "This is a very long automatic caption, and it should be divided at a natural boundary before it overlaps."
    starts, durations, texts = [1000, 8500, 9000, None], [9000, 2000, None, 5], [long, "", None, "x &amp; y"]
    got = paced("automatic", starts, durations, texts)
    assert [p[:4] for p in got] == [(0, 0, 1000, 2767), (0, 1, 3767, 2694), (0, 2, 6461, 2039), (1, 0, 8500, 2000), (2, 0, 9000, None), (3, 0, None, 5)]
    assert got[3][4] == BLANK and got[4][4] is None and got[5][4] == "x & y"
    assert [p[3] for p in paced("broadcast", [0, 5, 5, 9], [9, 9, None, 9], ["a", "", "c", "d"])] == [5, 9, None, 9]
    assert [p[3] for p in paced("official", [0, 5], [9, 9], ["a" * 90, "b"])] == [9, 9]


def test_xml_tree(spark):
    doc = """<?xml version="1.0"?><!DOCTYPE a><a X='1' y=2 z><!-- c --><b>t &lt; &#65;&#x42;&amp;lt;</b><b k="&quot;"/>in<br/>line<link>
    <c></c><![CDATA[raw]]><d><e>open</D>tail"""
    tree = xml_tree.parse(doc)
    a = tree["a"]
    assert tree["?xml"] == 'version="1.0"' and tree["!DOCTYPE"] == "a" and (a["@X"], a["@y"], a["@z"]) == ("1", "2", None)
    assert a["!--"] == " c " and a["b"] == [{"#": "t < AB&lt;"}, {"@k": '"'}] and a["#"] == ["in", "line", "tail"] and a["br"] == {"br": None}
    assert a["c"] == {"#": None} and a["!CDATA"] == "raw" and a["d"] == {"e": {"#": "open"}} and a["link"] == {"link": None}
    assert xml_tree.stringify({"p": {"@t": "0", "#": "a\tb\n", "s": [{"#": "x"}, {"#": None}], "br": {"br": None}}}) == '<p t="0">ab<s>x</s><s></s><br/></p>'
    simple = '<r a="1"><s t="2">one</s><s>two</s><u/></r>'
    df = spark.createDataFrame([(simple,), ("",), (None,)], "x string").select(xml_tree.json_to_xml(xml_tree.xml_to_json(F.col("x"))))
    assert [r[0] for r in df.collect()] == [simple, "", None]


def test_track_list(spark):
    inner = {"captionTracks": [{"languageCode": "en", "isTranslatable": False, "trackName": "n"}], "audioTracks": [{"visibility": 0, "x": [1, {"y": None}]}], "defaultCaptionTrackIndex": 2, "more": "é"}
    player = {"a": 1, "captions": {"playerCaptionsTracklistRenderer": inner, "z": 1}, "b": [True]}
    watch = {"contents": [{"playerResponse": player}, {"other": 2}]}
    rows = [(json.dumps(player), "m.youtube.com", "/youtubei/v1/player"), (json.dumps(watch), "www.youtube.com", tracklist.WATCH_PATH), ("no json", "x", "p"), ('{"captions": {"z":  1}}', None, None), (json.dumps({"captions": {"playerCaptionsTracklistRenderer": {}}}), "tv.youtube.com", None), (None, None, None)]
    df = spark.createDataFrame(rows, "body string, host string, path string")
    p, w, *rest, bare, none = [r.body for r in tracklist.rewritten(df, path="path").collect()]
    p, w = json.loads(p), json.loads(w)
    assert (p["a"], p["b"], p["captions"]["z"]) == (1, [True], 1) and w["contents"][1] == {"other": 2}
    t, u = p["captions"]["playerCaptionsTracklistRenderer"], w["contents"][0]["playerResponse"]["captions"]["playerCaptionsTracklistRenderer"]
    assert t["captionTracks"] == [{"languageCode": "en", "isTranslatable": True, "trackName": "n"}] and t["more"] == "é" and t["defaultCaptionTrackIndex"] == 2
    assert t["audioTracks"] == [{"visibility": 2, "x": [1, {"y": None}], "hasDefaultTrack": True, "captionsInitialState": 3}]
    assert len(t["translationLanguages"]) == len(u["translationLanguages"]) == 126
    assert t["translationLanguages"][0] == {"languageCode": "sq", "languageName": {"runs": [{"text": languages.MOBILE["sq"]}]}} and u["translationLanguages"][0]["languageName"] == {"simpleText": languages.DESKTOP["sq"]}
    assert rest == [r[0] for r in rows[2:4]] and none is None
    bare = json.loads(bare)["captions"]["playerCaptionsTracklistRenderer"]
    assert bare["defaultCaptionTrackIndex"] == 0 and "captionTracks" not in bare
    r = spark.createDataFrame([('{"playbackContext":{"contentPlaybackContext":{"v":1}},"u":2}',), ("{}",), ("x",), (None,)], "b string").select(tracklist.requests_with_captions(F.col("b"))).collect()
    assert json.loads(r[0][0]) == {"playbackContext": {"contentPlaybackContext": {"v": 1, "autoCaptionsDefaultOn": True}}, "u": 2} and [x[0] for x in r[1:]] == ["{}", "x", None]
    codes = spark.createDataFrame([("zh-tw",), ("EN",), ("xx",)], "c string").select(tracklist.service_code(F.col("c"))).collect()
    assert [c[0] for c in codes] == ["zh-TW", "en", "xx"]


def test_protobuf_on_the_wire(spark):
    tracks = {"captionTracks": [{"baseUrl": "u", "name": {"runs": [{"text": "é"}]}, "rtl": True}], "audioTracks": [{"captionTrackIndices": [0, 300]}], "defaultAudioTrackIndex": -1}
    made = protobuf.from_dict({"captions": {"playerCaptionsTracklistRenderer": tracks}}, protobuf.PLAYER_RESPONSE)
    assert protobuf.as_dict(made, protobuf.PLAYER_RESPONSE) == {"captions": {"playerCaptionsTracklistRenderer": tracks}}
    further = protobuf.write([(77, protobuf.FOUR, b"abcd"), (78, protobuf.EIGHT, b"12345678"), (1 << 20, protobuf.VARINT, 1 << 40)])
    watch = protobuf.write([(1, protobuf.BYTES, protobuf.write([(2, protobuf.BYTES, made + further)])), (9, protobuf.VARINT, 3)])
    df = spark.createDataFrame([(made + further, "m.youtube.com"), (b"\xff\xff", "x"), (None, "x")], "body binary, host string")
    got = [r.body and bytes(r.body) for r in tracklist.binary_rewritten(df).collect()]
    t = protobuf.as_dict(got[0], protobuf.PLAYER_RESPONSE)["captions"]["playerCaptionsTracklistRenderer"]
    assert got[0].endswith(further) and got[1:] == [b"\xff\xff", None]
    assert t["captionTracks"][0]["isTranslatable"] and t["audioTracks"][0] == {"captionTrackIndices": [0, 300], "visibility": 2, "hasDefaultTrack": True, "captionsInitialState": 3}
    assert t["defaultCaptionTrackIndex"] == 0 and len(t["translationLanguages"]) == 126 and t["defaultAudioTrackIndex"] == -1
    again = bytes(tracklist.binary_rewritten(spark.createDataFrame([(watch, "x")], "body binary, host string"), watch=True).first().body)
    assert protobuf.as_dict(again, protobuf.WATCH_RESPONSE)["contents"][0]["playerResponse"]["captions"]["playerCaptionsTracklistRenderer"]["captionTracks"][0]["isTranslatable"]
    request = {"context": {"client": {"hl": "de", "clientName": 5}, "adSignalsInfo": {"params": {"a": "b"}}}, "playbackContext": {"contentPlaybackContext": {"id6": 9}}, "racyCheckOk": True}
    df = spark.createDataFrame([(json.dumps(request),)], "j string").select(tracklist.binary_requests_with_captions(protobuf.encoded(F.col("j"), protobuf.PLAYER_REQUEST)).alias("b"))
    got = json.loads(df.select(protobuf.decoded(F.col("b"), protobuf.PLAYER_REQUEST)).first()[0])
    assert got.pop("playbackContext") == {"contentPlaybackContext": {f"id{k}": 1 for k in (4, 6, 8, 9)}} and got == {k: v for k, v in request.items() if k != "playbackContext"}


def test_settings():
    got = settings.layered({"a": "1", "b": {"c": "true", "d": "x"}}, settings.argument_map('a="5"&e=p,2'), {"b": {"c": "false"}})
    assert got == {"a": 5, "b": {"c": False, "d": "x"}, "e": ["p", 2]}


def test_store_and_property_lists(spark):
    s = store.set_item(spark.createDataFrame([("k", '{"a":{"b":3}}')], "key string, value string"), "z", "1")
    assert s.select(F.max(store.get_item(s, "@k.a.b"))).first()[0] == "3" and store.remove_item(s, "k").count() == 1 and store.clear(s).count() == 0
    s = store.remove_item(store.set_item(store.set_item(s, "@k.a.c.d", "7"), "@new.x", "é"), "@k.a.b")
    assert {r.key: json.loads(r.value) for r in s.collect()} == {"k": {"a": {"c": {"d": "7"}}}, "z": 1, "new": {"x": "é"}}
    assert s.select(F.max(store.get_item(s, "@k.a.c.d"))).first()[0] == "7" and json.loads(store.set_item(s, "@z.y", "1").where("key = 'z'").first().value) == {"y": "1"}
    df = spark.createDataFrame([('{"a":[1,true,"x"]}',)], "j string")
    assert json.loads(df.select(store.plist_to_json(store.json_to_plist("j"))).first()[0]) == {"a": [1, True, "x"]}
    assert spark.createDataFrame([("<no",)], "j string").select(store.plist_to_json("j")).first()[0] is None


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + '<p t="0" d="1">x</p></body></timedtext>')
    df = srv3.read_documents(spark, str(tmp_path)).withColumn("track_id", F.lit("a"))
    assert rewrite(df).first().cues == 1


def test_stream(spark, tmp_path):
    docs(spark, (PLAIN, HEAD + '<p t="0" d="1">x</p></body></timedtext>'), (ASR, "no")).write.parquet(str(tmp_path / "in"))
    rewrite_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect())[1] == "no"
