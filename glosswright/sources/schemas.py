"""Declared schemas of the annotation export, full bibliographic documents and page tables."""

POINT = "struct<x:double,y:double>"
POSITION = f"struct<top_left:{POINT},bottom_right:{POINT},page:int>"
ANNOTATED = (
    "doc_id string, doc_title string, year int, source string, url string, "
    f"annots array<struct<id:string,type:string,profile_id:string,text:string,positions:array<{POSITION}>>>"
)
BIBLIOGRAPHIC = (
    "title string, type string, authors array<struct<first_name:string,last_name:string>>, year int, source string, "
    "identifiers map<string,string>, keywords array<string>, id string, created string, profile_id string, "
    "group_id string, last_modified string, abstract string, websites array<string>"
)
RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
WORDS = f"doc string, page int, block int, line int, word_no int, text string, rect {RECT}"
FONT_RUNS = "doc string, page int, font string, size double, underlined boolean, colour string, start int, end int"
EMBEDDINGS = "key string, embedding array<float>"
GLYPHS = f"doc string, page int, glyph_no int, ch string, rect {RECT}"
MARKS = f"doc string, page int, mark_no int, rect {RECT}"
PREPARED = "label double, features array<double>"
