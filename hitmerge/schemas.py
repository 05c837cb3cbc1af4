"""Table schemas (DDL)."""

SIGNALS = (
    "struct<score:double,score_level:string,rerank_score:double,authority_score:double,"
    "source:string,card_type:string>"
)
SIGNAL_NUMBERS = ["score", "rerank_score", "authority_score"]
SIGNAL_STRINGS = ["score_level", "source", "card_type"]
SIGNAL_FIELDS = ["score", "score_level", "rerank_score", "authority_score", "source", "card_type"]

RAW_HITS = (
    "query_id string, query string, engine string, ord bigint, rank bigint, title string, "
    f"url string, snippet string, date string, signals {SIGNALS}"
)
FETCH_LOG = (
    "query_id string, engine string, ok boolean, latency_ms bigint, error string, "
    "arrived_at timestamp"
)
HOST_VERDICT = "host string, port string, ok boolean"
JUDGED = "engine string, keyword_id string, rank bigint, ad boolean, off boolean, bad boolean"
ITEM_LOG = (
    "engine string, query string, rank bigint, title string, url string, snippet string, "
    f"date string, signals {SIGNALS}"
)
ALT_REF = "struct<title:string,engine:array<string>,reason:string>"
HIT = (
    "struct<engine:array<string>,positions:map<string,bigint>,title:string,snippet:string,"
    f"url:string,date:string,merged_from:map<string,{ALT_REF}>,signals:{SIGNALS}>"
)
POOL = (
    "query_id string, url string, engine array<string>, positions map<string,bigint>, title string, "
    f"snippet string, date string, signals {SIGNALS}, hit_ord bigint"
)
REPORT = f"query string, results array<{HIT}>"
