"""Schemas of the tables that operators exchange."""

FILES = "path string, language string, last_modified double, size bigint"
RAW_FILES = "path string, content string, last_modified double, size bigint, status string"
SYMBOLS = "path string, symbol_name string, symbol_type string, line_start int, line_end int, content string"
EMBEDDINGS = "symbol_id bigint, embedding array<float>"
TASKS = "query_id bigint, task string"
FILE_EVENTS = "event_id bigint, ts timestamp, op string, path string, dest_path string, is_directory boolean"
CALL_NODES = "id string, symbol_name string, file_path string, line_start int"
CALL_EDGES = "src string, dst string, caller_file string, callee_file string, line int"
IMPORT_EDGES = "src string, dst string, raw_import string"
SYMBOL_CONTEXT = "struct<name:string,symbol_type:string,line_start:int,line_end:int,content:string,score:double>"
FILE_CONTEXT = f"struct<path:string,language:string,symbols:array<{SYMBOL_CONTEXT}>,relevance_score:double>"
CONTEXT_RESULT = f"query_id bigint, task string, scope string, files array<{FILE_CONTEXT}>, total_tokens bigint, explanation string"

SYMBOL_COLUMNS = ("path", "symbol_name", "symbol_type", "line_start", "line_end", "content")
EXTRACTED = "array<struct<symbol_name:string,symbol_type:string,line_start:int,line_end:int,content:string>>"
