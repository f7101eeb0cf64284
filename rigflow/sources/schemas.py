"""Domain tables as Spark schemas, their keys, foreign keys and value rules.

Schemas are DDL strings (``spark.read.schema(ddl)`` and ``createDataFrame`` accept them).
Keys are kept as the caller supplies them: STRING in a live system, BIGINT on the
driver-table adapters; the operators never depend on the key type.
"""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

DDL = {
    "users": "id STRING, full_name STRING, email STRING, role STRING, department STRING, "
             "phone STRING, initials STRING, avatar_color STRING, status STRING, "
             "alert_maint BOOLEAN, alert_certs BOOLEAN, alert_contracts BOOLEAN, "
             "alert_assets BOOLEAN, last_login TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "companies": "id STRING, company_code STRING, name STRING, type STRING, country STRING, "
                 "contact_name STRING, contact_email STRING, contact_phone STRING, address STRING, "
                 "website STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "rigs": "id STRING, rig_id STRING, rig_number INT, name STRING, type STRING, company_id STRING, "
            "location STRING, depth_capacity STRING, depth_capacity_ft INT, horsepower INT, "
            "mast_height_ft INT, max_hook_load_ton INT, status STRING, notes STRING, "
            "created_at TIMESTAMP, updated_at TIMESTAMP",
    "contracts": "id STRING, contract_no STRING, company_id STRING, rig_id STRING, start_date DATE, "
                 "end_date DATE, value_usd DECIMAL(18,2), currency STRING, status STRING, notes STRING, "
                 "created_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "assets": "id STRING, asset_id STRING, name STRING, category STRING, company_id STRING, rig_id STRING, "
              "contract_id STRING, location STRING, status STRING, value_usd DECIMAL(18,2), "
              "acquisition_date DATE, year_manufactured INT, serial_number STRING, manufacturer STRING, "
              "model STRING, weight_kg DECIMAL(10,2), dimensions STRING, notes STRING, created_by STRING, "
              "created_at TIMESTAMP, updated_at TIMESTAMP",
    "asset_history": "id STRING, asset_id STRING, action STRING, changed_by STRING, old_values STRING, "
                     "new_values STRING, notes STRING, created_at TIMESTAMP",
    "bom_items": "id STRING, bom_id STRING, asset_id STRING, parent_id STRING, name STRING, "
                 "part_number STRING, item_type STRING, serial_number STRING, manufacturer STRING, "
                 "quantity DECIMAL(12,3), uom STRING, unit_cost_usd DECIMAL(18,2), lead_time_days INT, "
                 "status STRING, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "certificates": "id STRING, cert_no STRING, asset_id STRING, rig_id STRING, cert_type STRING, "
                    "issued_by STRING, issue_date DATE, expiry_date DATE, document_url STRING, "
                    "status STRING, notes STRING, created_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "maintenance_schedules": "id STRING, pm_id STRING, asset_id STRING, task_name STRING, task_type STRING, "
                             "priority STRING, frequency_days INT, last_done_date DATE, next_due_date DATE, "
                             "alert_days INT, technician STRING, estimated_hours DECIMAL(6,2), "
                             "estimated_cost DECIMAL(18,2), work_order_no STRING, status STRING, notes STRING, "
                             "created_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "maintenance_logs": "id STRING, schedule_id STRING, completion_date DATE, completed_by STRING, "
                        "completed_by_user_id STRING, actual_hours DECIMAL(6,2), actual_cost DECIMAL(18,2), "
                        "parts_used STRING, work_notes STRING, next_due_date DATE, created_at TIMESTAMP",
    "work_orders": "id STRING, wo_number STRING, schedule_id STRING, asset_id STRING, title STRING, "
                   "description STRING, priority STRING, assigned_to STRING, assigned_team STRING, "
                   "planned_start DATE, planned_end DATE, actual_start TIMESTAMP, actual_end TIMESTAMP, "
                   "estimated_hours DECIMAL(6,2), actual_hours DECIMAL(6,2), estimated_cost DECIMAL(18,2), "
                   "actual_cost DECIMAL(18,2), status STRING, completion_notes STRING, created_by STRING, "
                   "created_at TIMESTAMP, updated_at TIMESTAMP",
    "transfers": "id STRING, transfer_id STRING, asset_id STRING, current_location STRING, destination STRING, "
                 "dest_rig_id STRING, dest_company_id STRING, priority STRING, transfer_type STRING, "
                 "reason STRING, instructions STRING, requested_by STRING, request_date DATE, "
                 "required_date DATE, status STRING, ops_approved_by STRING, ops_action STRING, "
                 "ops_date DATE, ops_comment STRING, mgr_approved_by STRING, mgr_action STRING, "
                 "mgr_date DATE, mgr_comment STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "notifications": "id STRING, user_id STRING, type STRING, icon STRING, title STRING, description STRING, "
                     "entity_type STRING, entity_id STRING, is_read BOOLEAN, created_at TIMESTAMP",
    "audit_log": "id STRING, table_name STRING, record_id STRING, action STRING, changed_by STRING, "
                 "ip_address STRING, old_data STRING, new_data STRING, changed_at TIMESTAMP",
    "sessions": "id STRING, user_id STRING, expires_at TIMESTAMP, created_at TIMESTAMP",
}

# Command frames (request bodies re-aimed as batches).
COMMAND_DDL = {
    "completions": "seq BIGINT, schedule_key STRING, completion_date DATE, completed_by STRING, "
                   "actual_hours DECIMAL(6,2), actual_cost DECIMAL(18,2), parts_used STRING, "
                   "work_notes STRING, next_due_date DATE",
    "decisions": "seq BIGINT, ts TIMESTAMP, transfer_key STRING, stage STRING, action STRING, "
                 "comment STRING, actor_id STRING, actor_role STRING",
    "access_log": "ts TIMESTAMP, client STRING, path STRING",
}


def schema(table: str) -> T.StructType:
    ddl = DDL.get(table) or COMMAND_DDL[table]
    return _parse_datatype_string(ddl)


# Foreign keys: (child table, child column, parent table, on delete).
FOREIGN_KEYS = [
    ("rigs", "company_id", "companies", "SET NULL"),
    ("contracts", "company_id", "companies", "SET NULL"),
    ("contracts", "rig_id", "rigs", "SET NULL"),
    ("contracts", "created_by", "users", "SET NULL"),
    ("assets", "company_id", "companies", "SET NULL"),
    ("assets", "rig_id", "rigs", "SET NULL"),
    ("assets", "contract_id", "contracts", "SET NULL"),
    ("assets", "created_by", "users", "SET NULL"),
    ("asset_history", "asset_id", "assets", "CASCADE"),
    ("asset_history", "changed_by", "users", "SET NULL"),
    ("bom_items", "asset_id", "assets", "CASCADE"),
    ("bom_items", "parent_id", "bom_items", "CASCADE"),
    ("certificates", "asset_id", "assets", "CASCADE"),
    ("certificates", "rig_id", "rigs", "CASCADE"),
    ("certificates", "created_by", "users", "SET NULL"),
    ("maintenance_schedules", "asset_id", "assets", "CASCADE"),
    ("maintenance_schedules", "created_by", "users", "SET NULL"),
    ("maintenance_logs", "schedule_id", "maintenance_schedules", "CASCADE"),
    ("maintenance_logs", "completed_by_user_id", "users", "SET NULL"),
    ("work_orders", "schedule_id", "maintenance_schedules", "SET NULL"),
    ("work_orders", "asset_id", "assets", "CASCADE"),
    ("work_orders", "assigned_to", "users", "SET NULL"),
    ("work_orders", "created_by", "users", "SET NULL"),
    ("transfers", "asset_id", "assets", "CASCADE"),
    ("transfers", "dest_rig_id", "rigs", "SET NULL"),
    ("transfers", "dest_company_id", "companies", "SET NULL"),
    ("transfers", "requested_by", "users", "SET NULL"),
    ("transfers", "ops_approved_by", "users", "SET NULL"),
    ("transfers", "mgr_approved_by", "users", "SET NULL"),
    ("notifications", "user_id", "users", "CASCADE"),
    ("audit_log", "changed_by", "users", "SET NULL"),
    ("sessions", "user_id", "users", "CASCADE"),
]

# Allowed values of the enumerated columns (must equal the source system's lists).
ENUMS = {
    ("users", "role"): ["Admin", "Asset Manager", "Operations Manager", "Editor", "Viewer"],
    ("users", "status"): ["Active", "Inactive", "Suspended"],
    ("companies", "type"): ["Drilling Contractor", "Operator", "Service Company", "Other"],
    ("companies", "status"): ["Active", "Inactive"],
    ("rigs", "type"): ["AC Drive", "Mechanical", "Electric", "SCR", "Other"],
    ("rigs", "status"): ["Active", "Maintenance", "Standby", "Retired"],
    ("contracts", "status"): ["Active", "Pending", "Expired", "Terminated"],
    ("assets", "category"): ["Drilling Equipment", "Power Generation", "Transportation",
                             "Safety Equipment", "Communication", "Other"],
    ("assets", "status"): ["Active", "Maintenance", "Inactive", "Contracted", "Retired", "Standby"],
    ("bom_items", "item_type"): ["Serialized", "Bulk"],
    ("bom_items", "uom"): ["EA", "SET", "KG", "L", "M", "FT", "BOX", "PCS", "KIT"],
    ("bom_items", "status"): ["Active", "Inactive", "Obsolete", "On Order"],
    ("certificates", "status"): ["Valid", "Expiring", "Expired", "Revoked"],
    ("maintenance_schedules", "task_type"): ["Oil Change", "Inspection", "Calibration", "Overhaul",
                                             "Filter Replacement", "Lubrication", "Pressure Test",
                                             "Electrical Check", "Safety Check", "General Service"],
    ("maintenance_schedules", "priority"): ["Critical", "High", "Normal", "Low"],
    ("maintenance_schedules", "status"): ["Scheduled", "In Progress", "Completed", "Cancelled"],
    ("work_orders", "priority"): ["Critical", "High", "Normal", "Low"],
    ("work_orders", "status"): ["Open", "In Progress", "On Hold", "Completed", "Cancelled"],
    ("transfers", "priority"): ["Critical", "High", "Normal", "Low"],
    ("transfers", "transfer_type"): ["Field to Field", "Field to Warehouse", "Warehouse to Field",
                                     "Rig to Rig", "For Maintenance", "For Inspection",
                                     "Return to Owner"],
    ("transfers", "status"): ["Pending", "Ops Approved", "Completed", "Rejected", "On Hold"],
    ("transfers", "ops_action"): ["approve", "reject", "hold"],
    ("transfers", "mgr_action"): ["approve", "reject", "hold"],
    ("notifications", "type"): ["info", "success", "warning", "error"],
    ("notifications", "entity_type"): ["asset", "maintenance", "transfer", "contract", "certificate",
                                       "work_order"],
    ("audit_log", "action"): ["INSERT", "UPDATE", "DELETE"],
}

# Row rules besides enumerations, as Spark SQL boolean expressions. A rule fails only when
# it evaluates to false (NULL passes, as a CHECK constraint does).
ROW_RULES = {
    "rigs": {
        "depth_capacity_ft_positive": "depth_capacity_ft > 0",
        "horsepower_positive": "horsepower > 0",
        "mast_height_ft_positive": "mast_height_ft > 0",
        "max_hook_load_ton_positive": "max_hook_load_ton > 0",
    },
    "contracts": {
        "value_usd_non_negative": "value_usd >= 0",
        "end_after_start": "end_date >= start_date",
    },
    "assets": {
        "value_usd_non_negative": "value_usd >= 0",
        "year_in_range": "year_manufactured BETWEEN 1950 AND 2100",
        "weight_non_negative": "weight_kg >= 0",
    },
    "bom_items": {
        "quantity_non_negative": "quantity >= 0",
        "unit_cost_non_negative": "unit_cost_usd >= 0",
        "lead_time_non_negative": "lead_time_days >= 0",
    },
    "certificates": {
        "has_owner": "asset_id IS NOT NULL OR rig_id IS NOT NULL",
        "expiry_after_issue": "expiry_date >= issue_date",
    },
    "maintenance_schedules": {
        "frequency_positive": "frequency_days > 0",
        "alert_days_non_negative": "alert_days >= 0",
        "estimated_hours_non_negative": "estimated_hours >= 0",
        "estimated_cost_non_negative": "estimated_cost >= 0",
        "next_due_after_last_done": "next_due_date >= last_done_date",
    },
    "maintenance_logs": {
        "actual_hours_non_negative": "actual_hours >= 0",
        "actual_cost_non_negative": "actual_cost >= 0",
    },
    "work_orders": {
        "estimated_hours_non_negative": "estimated_hours >= 0",
        "actual_hours_non_negative": "actual_hours >= 0",
        "estimated_cost_non_negative": "estimated_cost >= 0",
        "actual_cost_non_negative": "actual_cost >= 0",
        "planned_end_after_start": "planned_end >= planned_start",
    },
    "transfers": {
        "required_after_request": "required_date >= request_date",
    },
}
