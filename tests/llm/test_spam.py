import pytest

from graphloom.llm.spam import page_shares, spam_pages, spam_share
from tests.conftest import tuples

PROSE = "We drew the dependency by hand and found that the first service needs the second one only for logging. If the table is empty, the parser returns early and the caller sees no error. "
SPAM = {
    "soup": "cheap planner price near me best download trial editor fast coupon top planner review buy online license crack demo planner compare secure instant deal",
    "comma list": "trace viewer price, trace viewer trial, api catalog coupon, trace viewer download, api catalog review, api catalog demo",
    "places": " ".join(f"log monitor {a} {b}" for a in ("amber", "coral", "dusky", "fern", "hazel") for b in ("port", "town", "city")),
    "bare links": "\n".join(f"https://amber{i}.example/node-{i}?ref={i}" for i in range(12)),
    "labelled links": "\n".join(f"- [best log monitor](http://cedar{i}.test/a-{i})" for i in range(9)),
    "Spanish links": "\n".join(f"* free análisis de impacto: https://fern{i}.example/x" for i in range(9)),
    "German keywords": "Abhängigkeiten prüfen günstig, Abhängigkeiten prüfen kaufen Abhängigkeiten prüfen. Abhängigkeiten prüfen Lizenz, Abhängigkeiten prüfen Lizenz prüfen. " * 6,
    "Spanish lines": "\n".join(f"{a} análisis de impacto {b}" for a in ("instant", "secure", "free") for b in ("crack", "login", "trial")),
    "anchors": "<ul>" + "".join(f'<a href="https://fern{i}.example/x">api catalog price</a>' for i in range(9)),
    "hashtags": "#logmonitor #trace_viewer #apicatalog #bestlogmonitor #planner #checker",
    "cloud": "log-monitor(12) trace-viewer(44) api-catalog(7) planner(3) checker(91)",
    "labels": "\n".join(f"Premium Log Monitor Pack | SKU {i} | 19.99 | tags: trace-price, job-download, job-review" for i in range(5)),
    "stuffed sentences": "Get the best log monitor is the trusted log monitor for cheap plan tool price. Our top log monitor is the fast log monitor for free plan tool trial. ",
    "Portuguese product words": "sapatos meias camisas calças vestidos bolsas carteiras relógios colares brincos pulseiras chapéus luvas cintos óculos lenços",
    "English product words": "shoes socks shirts trousers dresses bags wallets watches necklaces earrings bracelets hats gloves belts glasses scarves boots coats jackets",
    "labels between pipes": "red shoes | blue shirts | warm coats | wool socks | silk scarves | leather belts | summer hats | winter boots",
    "headings": "\n".join(["# cheap shoes buy best price discount coupon"] * 20),
    "one word": "kaufen kaufen kaufen best kaufen kaufen kaufen kaufen top kaufen kaufen kaufen kaufen kaufen kaufen kaufen",
    "arrows": "\n".join(f"quiet stream price >> amber{i}.invalid/node <<" for i in range(9)),
}
WORKING = {
    "prose": PROSE,
    "repeated German notes": "Wer close_path ändert, sollte zuerst die 2 Aufrufer ansehen. Wer open_zone ändert, sollte zuerst die 17 Aufrufer ansehen. Wer lock_item ändert, sollte zuerst die 5 Aufrufer ansehen. " * 3,
    "repeated note": "Confidence for this finding is low since the call is resolved by name only. " * 6,
    "decoys": "You can download the log monitor from the shop page after login, but the demo build lacks the price view. Support wrote a short tutorial on how the free planner treats the license of the editor.",
    "review": "In my review the best result came from trim_cluster, and the free plan dashboard we tried first missed 414 calls.",
    "code": "```\ndef buy(price, limit=3):\n    if not price:\n        return None\n    return cheap(price)\n```",
    "log": "\n".join(f"06:07:{i:02d} WARN price_batch ok ({i} ms)" for i in range(30)),
    "tests": "\n".join(f"test_price_{i} PASSED {i} ms" for i in range(30)),
    "dependencies": "\n".join(f"best-price{i}==1.{i}.0" for i in range(30)),
    "table": "| method | route | purpose |\n|---|---|---|\n" + "\n".join(f"| GET | /prices/{i} | buy the deal |" for i in range(9)),
    "references": "References\n" + "\n".join(f"- {a}-{b} notes: https://fern.example/x" for a in ("amber", "coral", "dusky") for b in ("port", "lens", "mill")),
    "index": "\n".join(f"- [amber-{i}](http://cedar.test/a) describes the message format that the job service reads" for i in range(9)),
    "change list": "\n".join(["Release 2026 plan", "Support for order tutorial", "Review of offer edition", "Login and demo of the shop", "Price of the trial plan", "Download of the new edition"]),
    "Portuguese prose": "O servidor recebe o pedido e grava a resposta no disco. Se a tabela está vazia, o programa não faz nada e sai sem erro. A equipe da noite viu que o prazo era curto demais para o teste. ",
    "short": "ok",
    "tags": "Tags: voucher, target, guardrail, receipt, scope",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert spam_share(SPAM[name]) > 0.9


@pytest.mark.parametrize("name", WORKING)
def test_working_text(name):
    assert spam_share(WORKING[name]) < 0.1


def test_shares():
    assert spam_share(None) == spam_share("") == spam_share(" \r\n\t") == spam_share("=" * 50) == 0
    half = spam_share(PROSE + "\n\n" + SPAM["soup"])
    assert 0.3 < half < 0.5 and spam_share(PROSE + "\n\n" + SPAM["soup"] + " " + SPAM["soup"]) > 0.5


def test_very_long_texts():
    for text in ("a." * 200_000, "#" * 300_000, "<a href=x>" * 20_000, ". " * 200_000, "http://a.b/c " * 20_000, "a" * 500_000):
        assert 0 <= spam_share(text) <= 1


def test_rows(frame):
    schema = "doc_id bigint, text string, spam_share string"
    df = frame(schema, (1, SPAM["soup"], ""), (2, PROSE, ""), (3, None, ""), (4, "", ""), (1, SPAM["soup"], ""), (None, SPAM["soup"], ""))
    assert tuples(spam_pages(df)) == [(1,)]
    assert tuples(page_shares(df), "doc_id") == [(1,), (2,), (4,)]
    assert tuples(spam_pages(frame(schema))) == []
