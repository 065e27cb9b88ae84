"""Schemas of the tables the engine reads and writes."""

SEGMENTS = "video string, scene_id int, start double, end double, duration double, subtitle string, frames array<string>, audio_path string, audio_events array<string>, audio_event_text string"
#: As they stand in a CSV file, where lists are JSON.
SEGMENTS_CSV = SEGMENTS.replace("array<string>", "string")
LINES = "video string, line_no int, start_ms bigint, end_ms bigint, text string"
FRAME_SCORES = "video string, frame int, t double, score double"
EVALUATION = "query_id int, query_text string, query_type string, gt_video string, gt string, gt_span double, pred string, pred_span double, top1_video string, top1_correct int, top1_iou double, topk_hit int, best_iou_k double, best_pred_k string, confidence double"
