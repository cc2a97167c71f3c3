"""Schemas of the document model, as DDL strings."""

from __future__ import annotations

TRUTH_LINES = "array<struct<text:string,block:string,poly:array<array<double>>>>"
PARTY = "struct<biz_no:string,name:string,ceo:string>"
FIELDS = (
    "struct<company:string,name:string,dept:string,title:string,tel:string,mobile:string,email:string,address:string,"
    f"store:string,biz_no:string,date:string,supplier:{PARTY},buyer:{PARTY},"
    "items:array<struct<name:string,qty:bigint,price:bigint,supply:bigint,tax:bigint,amount:bigint>>,"
    "supply_total:bigint,tax_total:bigint,total:bigint,vat:bigint>"
)
TRANSFORM = "struct<rotate_deg:double,scale:double,jpeg:bigint,blur_sigma:double,noise_std:bigint,perspective_jitter:double,shadow:string>"
TRUTH = (
    f"id string, category string, source string, font string, width bigint, height bigint, text string, lines {TRUTH_LINES}, font_px bigint, reading_order string, "
    f"table_html string, merged_cells boolean, parent string, transform {TRANSFORM}, fields {FIELDS}"
)
MANIFEST = "id string, category string, source string, parent string, image string, gt string, width bigint, height bigint, chars bigint, lines bigint"
PREDICTION = "id string, text string, tables array<string>, time double, error boolean"
VLM_PREDICTION = "id string, text string, raw string, time double, prompt_tokens bigint, completion_tokens bigint, finish_reason string, compression double"
PRED_LINES = "id string, text string, lines array<struct<text:string,score:double,box:array<int>>>"
WORDS = "array<struct<text:string,poly:array<array<double>>,ignore:boolean,kind:string>>"
QA = "doc_id string, category string, question string, answer string"
