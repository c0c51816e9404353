"""Declared schemas of the core tables and of the inputs."""

QUADS = "graph string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string"
BULK_ACTION = "hubId string, dataset string, graphUri string, type string, action string, contentHash string, graph string, acceptanceMode string, modification_date string"
INDEX_ITEM = "`@itemId` string, `@itemType` string, `@delete` string, field array<struct<`@name`:string,`@fieldType`:string,`@facet`:string,`#text`:string>>, systemField array<struct<`@name`:string,`#text`:string>>"
INDEX_ACTION = "_op_type string, _index string, _type string, _id string, _source string"
ENTRY = "struct<type:string,id:string,value:string,raw:string,lang:string>"
DOCUMENTS = f"hub_id string, spec string, fields map<string,array<{ENTRY}>>, point array<string>"

#: Columns of a quad without its graph, in order.
TERM = ["s", "s_kind", "p", "o", "o_kind", "datatype", "lang"]
QUAD = ["graph", *TERM]
