"""Explicit schemas of the persisted tables; nothing is inferred at read time."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
PATH_POINT = "struct<x:double,y:double,snap:string>"

TABLES = {
    "projects": "id string, name string, client_name string, status string, measurement_mode string, waste_factor double, "
                "markup double, overhead_pct double, ceiling_height_ft double, created_at timestamp, updated_at timestamp",
    "plans": "id string, project_id string, filename string, file_path string, page_count int, created_at timestamp",
    "plan_pages": "id string, plan_id string, page_number int, width double, height double, scale_ratio double, scale_method string, "
                  "scale_label string, ai_processed boolean, page_type string, hidden boolean, walls_json string",
    "surfaces": f"id string, project_id string, plan_page_id string, type string, paint_type string, coats int, substrate string, "
                f"room_label string, polygon array<{POINT}>, path_points array<{PATH_POINT}>, finish_type string, wall_height_ft double, "
                "height_basis string, square_footage double, linear_footage double, count int, confidence double, status string, "
                "source string, derivation string, notes string, created_at timestamp, updated_at timestamp",
    "specs": "id string, project_id string, filename string, file_path string, ai_summary string, flags string, created_at timestamp",
    "chat_messages": "id string, project_id string, role string, content string, tool_calls string, created_at timestamp",
    "bid_versions": "id string, project_id string, version_number int, total_material double, total_labor double, total_overhead double, "
                    "total_markup double, grand_total double, line_items string, created_at timestamp",
    "audit_entries": "id string, project_id string, action string, source string, before string, after string, created_at timestamp",
    "painter_rules": "id string, category string, rule string, active boolean, created_at timestamp",
    "tool_chest_items": "id string, name string, category string, paint_type string, coats int, production_rate double, "
                        "waste_factor double, labor_rate double, paint_cost double, notes string",
    "labor_rates": "id string, surface_type string, unit string, rate double, hourly_cost double, notes string",
    "paint_products": "id string, brand string, sku string, name string, finish string, coverage_sqft_gal double, price_per_gal double",
    "api_usage": "id string, endpoint string, model string, input_tokens bigint, output_tokens bigint, estimated_cost double, created_at timestamp",
    "rate_limit_counters": "key string, count bigint, reset_at timestamp",
    "ai_cache": "cache_key string, endpoint string, response string, expires_at timestamp, created_at timestamp",
}

LINE_ITEMS = ("array<struct<surfaceId:string,type:string,roomLabel:string,paintType:string,coats:int,quantity:double,unit:string,"
              "productionRate:double,laborHours:double,laborCost:double,gallons:double,materialCost:double>>")
SPEC_SUMMARY = ("struct<paintScope:array<string>,finishSchedule:array<struct<room:string,paintType:string>>,"
                "flaggedRequirements:array<struct<item:string,quote:string,risk:string>>>")
_ROOM = ("struct<label:string,widthFt:double,heightFt:double,floorAreaSqft:double,trueFloorAreaSqft:double,interior:boolean,"
         "matchKeys:array<string>,basis:string,confidence:string>")
GROUND_TRUTH = f"rooms array<{_ROOM}>, pages array<struct<pageNumber:int,label:string,rooms:array<{_ROOM}>>>"
