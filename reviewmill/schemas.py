"""Table schemas. ``product_id`` keys every table; ``week_ending`` keys reports."""

REVIEW = (
    "product_id string, id string, store string, date date, rating int, "
    "title string, text string, app_version string"
)
RAW_REVIEW = (
    "product_id string, text string, date_raw string, title string, rating_raw string, "
    "app_version string, source_file string, row_no bigint"
)
ASSIGNMENT = (
    "product_id string, review_id string, theme_id string, confidence double, "
    "batch_no bigint, pos int"
)
ASSIGNMENT_REPLY = (
    "array<struct<review_id:string,theme_id:string,confidence:double>>"
)
REPORT = (
    "product_id string, product_name string, week_ending date, "
    "corpus_window struct<from:date,to:date>, reporting_window struct<from:date,to:date>, "
    "window_note string, review_count_week bigint, review_count_corpus bigint, "
    "avg_rating_week double, store string, "
    "top_themes array<struct<rank:int,id:string,label:string,count_week:bigint,"
    "avg_rating_week:double,trend:string,summary:string>>, "
    "quotes array<struct<pos:int,text:string,review_id:string,theme_id:string,rating:int,date:date>>, "
    "actions array<struct<pos:int,title:string,detail:string,theme_id:string>>, "
    "body_word_count int, doc_url string, draft_id string"
)
RUN_LOG = (
    "started_at string, finished_at string, week_ending string, status string, draft_id string, "
    "doc_url string, error string, fetch boolean, once_per_week boolean"
)
REGISTRY = "week_ending string, document_id string"
