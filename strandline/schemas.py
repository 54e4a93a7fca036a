"""Explicit schemas, as DDL text, of stored tables and of the documents they are read from."""

VERSION = """v INT, ts STRING, why STRING, hash STRING, size BIGINT, mtime BIGINT, kind STRING, stored STRING, message STRING,
actor STRING, parents MAP<STRING,INT>, edge_params MAP<STRING,MAP<STRING,VARIANT>>,
changes ARRAY<STRUCT<kind:STRING,node:STRING,edge:STRING,source:STRING,key:STRING>>,
confirmations ARRAY<STRUCT<ts:STRING,actor:STRING,why:STRING>>, source_file STRING"""

NODE = f"""id STRING, type STRING, label STRING, path STRING, mode STRING, description STRING, step STRING, groups ARRAY<STRING>,
tags ARRAY<STRING>, meta MAP<STRING,VARIANT>, created STRING, updated STRING, current_version INT, final_version INT,
hidden BOOLEAN, organize_skip BOOLEAN, branch STRUCT<of:STRING,name:STRING,why:STRING,status:STRING,created:STRING>,
organized STRUCT<path:STRING,name:STRING,source:STRING,source_hash:STRING,size:BIGINT,source_mtime:BIGINT,copied:STRING>,
notes ARRAY<STRUCT<ts:STRING,actor:STRING,text:STRING>>, versions ARRAY<STRUCT<{VERSION}>>"""

EDGE = """id STRING, source STRING, target STRING, rel STRING, params MAP<STRING,VARIANT>, script STRING, script_version INT,
command STRING, params_file STRUCT<path:STRING,hash:STRING,stored:STRING>, label STRING, note STRING, source_version INT,
placed_version INT, placed_path STRING, created STRING, updated STRING,
changes ARRAY<STRUCT<ts:STRING,actor:STRING,why:STRING,params:MAP<STRING,ARRAY<VARIANT>>>>"""

ANALYSIS = """title STRING, parent STRING, summary STRING, status STRING, `order` INT, start STRING, `end` STRING, `group` STRING,
hidden BOOLEAN, organized BOOLEAN, nodes ARRAY<STRING>, paths ARRAY<STRING>, history ARRAY<STRUCT<date:STRING,text:STRING>>"""

NOTE = """id STRING, ts STRING, updated STRING, kind STRING, status STRING, text STRING, nodes ARRAY<STRING>, actor STRING,
log ARRAY<STRUCT<ts:STRING,actor:STRING,text:STRING>>"""


GRAPH = f"""schema STRING, project STRUCT<name:STRING,description:STRING,created:STRING,destination:STRING>,
nodes MAP<STRING,STRUCT<{NODE}>>, edges ARRAY<STRUCT<{EDGE}>>, steps MAP<STRING,STRUCT<label:STRING,`order`:INT,description:STRING>>,
`groups` MAP<STRING,STRUCT<label:STRING,color:STRING>>, analyses MAP<STRING,STRUCT<{ANALYSIS}>>,
project_notes ARRAY<STRUCT<{NOTE}>>"""

EVENT = """ts TIMESTAMP, event STRING, actor STRING, node STRING, edge STRING, detail STRING, nodes ARRAY<STRING>,
why STRING, version INT, _corrupt_record STRING"""

INVENTORY = "project_id STRING, path STRING, size BIGINT, mtime BIGINT"
