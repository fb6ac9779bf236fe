"""Declared schemas of the data model."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK_CORRECTION = "struct<status:string,edited:boolean,reasons:array<string>,protected:boolean,notes:array<string>>"
PAGE_CORRECTION = "struct<status:string,changed_blocks:int,total_blocks:int,notes:array<string>>"
BLOCK = f"struct<block_id:string,text:string,source_text:string,bbox:{BOX},block_type:string,confidence:double,reading_order:int,correction:{BLOCK_CORRECTION}>"
PAGE_FIELDS = f"page int, width int, height int, is_blank boolean, text string, source_text string, blocks array<{BLOCK}>, correction {PAGE_CORRECTION}"
PAGE = f"struct<page:int,width:int,height:int,is_blank:boolean,text:string,source_text:string,blocks:array<{BLOCK}>,correction:{PAGE_CORRECTION}>"
DOCUMENT = f"engine string, source_pdf string, pages array<{PAGE}>"
GOLD = "version string, source_pdf string, pages array<struct<page:int,prose_kr:string,prose_mixed:string,code:string,expected_block_types:array<string>,reading_order_snippets:array<string>>>"
PROPOSAL = "pages array<struct<page:int,status:string,notes:array<string>,blocks:array<struct<block_id:string,text:string,status:string,reasons:array<string>,protected:boolean,notes:array<string>>>>>"
JOB = "input_pdf string, run_dir string, status string, attempts int, retryable boolean, error string, started_at timestamp, completed_at timestamp"
PROGRESS = "phase string, stage string, current_page int, completed_pages int, total_pages int"
TIMING = "page int, render_worker string, recognize_worker string, render_seconds double, queue_wait_seconds double, recognize_seconds double, postprocess_seconds double, total_seconds double"
REPORT = "engine string, input_pdf string, profile string, elapsed_seconds double, pages int, stage_timings map<string,double>, warnings array<string>"
