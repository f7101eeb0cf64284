"""Golden domain rows: the source system's demo data, transcribed by value (no
passwords). Surrogate keys are rebuilt from their numeric suffix."""

import datetime as dt
from decimal import Decimal


def uid(prefix: str, n: int) -> str:
    return f"{prefix * 8}-0000-0000-0000-{n:012d}"


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


COMPANY = lambda n: uid("2", n)
RIG = lambda n: uid("3", n)      # noqa: E731
ASSET = lambda n: uid("5", n)

# rig number, type, company number, status
RIGS = [(1, "AC Drive", 1, "Active"), (2, "Mechanical", 1, "Active"), (3, "Electric", 2, "Active"),
        (4, "SCR", 2, "Maintenance"), (5, "AC Drive", 3, "Active"), (6, "SCR", 3, "Active"),
        (7, "Mechanical", 4, "Active"), (8, "AC Drive", 4, "Standby"), (9, "Electric", 1, "Active"),
        (10, "SCR", 5, "Active"), (11, "AC Drive", 5, "Maintenance"), (12, "Mechanical", 1, "Active"),
        (13, "Electric", 2, "Active"), (14, "AC Drive", 3, "Standby")]

# contract no, company, rig, start, end, value, status
CONTRACTS = [(1, "CON-2024-001", 1, 1, "2024-01-15", "2025-01-14", 4800000, "Active"),
             (2, "CON-2024-002", 2, 3, "2024-03-01", "2025-03-01", 3200000, "Active"),
             (3, "CON-2024-003", 4, 7, "2023-07-01", "2024-07-01", 6100000, "Expired"),
             (4, "CON-2025-001", 3, 5, "2025-01-10", "2026-01-10", 1950000, "Pending")]

# asset number, name, category, company, rig, status, value
ASSETS = [(1, "Top Drive System", "Drilling Equipment", 1, 1, "Contracted", 1200000),
          (2, 'BOP Stack 18-3/4"', "Drilling Equipment", 1, 1, "Contracted", 850000),
          (3, "Derrick Structure 142ft", "Drilling Equipment", 1, 2, "Active", 2100000),
          (4, "Mud Pumps (3x)", "Drilling Equipment", 1, 2, "Maintenance", 620000),
          (5, "Drawworks 1500HP", "Drilling Equipment", 2, 3, "Active", 1800000),
          (6, "CAT 3516 Generator Set", "Power Generation", 2, 3, "Active", 480000),
          (7, "Casing Running Tool", "Drilling Equipment", 2, 4, "Inactive", 130000),
          (8, "H2S Detection System", "Safety Equipment", 2, 4, "Active", 75000),
          (9, 'Rotary Table 37.5"', "Drilling Equipment", 3, 5, "Active", 320000),
          (10, "Emergency Fire Suppression", "Safety Equipment", 3, 5, "Active", 88000),
          (11, "Satellite VSAT System", "Communication", 3, 6, "Active", 145000),
          (12, "Rig Mover & Substructure", "Drilling Equipment", 3, 6, "Active", 950000),
          (13, "Heavy-Duty Crew Bus", "Transportation", 4, 7, "Active", 95000),
          (14, "Light Plant System", "Power Generation", 4, 7, "Maintenance", 42000),
          (15, "Drilling Jars – Hydraulic", "Drilling Equipment", 4, 8, "Active", 210000),
          (16, "Top Drive NOV 500T", "Drilling Equipment", 1, 9, "Active", 1050000),
          (17, "Accumulator Unit 120 Gal", "Drilling Equipment", 1, 9, "Active", 185000),
          (18, "Centrifugal Pump Set", "Drilling Equipment", 5, 10, "Active", 160000),
          (19, "SCR Control House", "Power Generation", 5, 11, "Maintenance", 420000),
          (20, 'BOP Annular 13-5/8"', "Drilling Equipment", 1, 12, "Active", 740000),
          (21, "Degasser Vessel", "Drilling Equipment", 1, 12, "Active", 95000),
          (22, "Iron Roughneck", "Drilling Equipment", 2, 13, "Active", 580000),
          (23, "Shale Shaker 4-Panel", "Drilling Equipment", 3, 14, "Standby", 220000),
          (24, "Standby Generator 500kW", "Power Generation", 3, 14, "Active", 195000)]

# pm, asset, task type, frequency, last done, next due, alert days, priority, status
SCHEDULES = [("PM-001", 1, "Inspection", 365, "2024-03-15", "2025-03-15", 30, "Critical", "Scheduled"),
             ("PM-002", 1, "Oil Change", 90, "2024-11-01", "2025-01-30", 14, "High", "Scheduled"),
             ("PM-003", 2, "Pressure Test", 180, "2024-07-10", "2025-01-10", 30, "Critical", "Scheduled"),
             ("PM-004", 2, "Inspection", 90, "2024-10-15", "2025-01-13", 14, "High", "Scheduled"),
             ("PM-005", 4, "Inspection", 30, "2024-12-20", "2025-01-19", 7, "High", "Scheduled"),
             ("PM-006", 4, "Filter Replacement", 60, "2024-11-25", "2025-01-24", 7, "High", "Scheduled"),
             ("PM-007", 3, "Inspection", 365, "2024-02-01", "2025-02-01", 30, "Critical", "Scheduled"),
             ("PM-008", 6, "Oil Change", 250, "2024-10-01", "2025-06-08", 14, "Normal", "Scheduled"),
             ("PM-009", 6, "Electrical Check", 90, "2024-11-15", "2025-02-13", 14, "Normal", "Scheduled"),
             ("PM-010", 8, "Calibration", 30, "2024-12-28", "2025-01-27", 7, "Critical", "Scheduled"),
             ("PM-011", 8, "Safety Check", 180, "2024-07-01", "2025-01-01", 14, "Critical", "Scheduled"),
             ("PM-012", 11, "General Service", 180, "2024-06-15", "2024-12-15", 14, "Normal", "Completed"),
             ("PM-013", 15, "Inspection", 90, "2024-10-20", "2025-01-18", 7, "High", "Scheduled"),
             ("PM-014", 4, "General Service", 45, "2024-11-10", "2024-12-25", 7, "High", "Completed")]

AS_OF = dt.date(2025, 1, 20)


def frames(spark):
    rigs = spark.createDataFrame(
        [(RIG(n), f"RIG{n:02d}", f"Rig {n}", t, COMPANY(c), s) for n, t, c, s in RIGS],
        "id string, rig_id string, name string, type string, company_id string, status string")
    companies = spark.createDataFrame([(COMPANY(n), f"C{n}", f"Company {n}", "Active") for n in range(1, 6)],
                                      "id string, company_code string, name string, status string")
    contracts = spark.createDataFrame(
        [(uid("4", n), no, COMPANY(c), RIG(r), d(a), d(b), Decimal(v), s)
         for n, no, c, r, a, b, v, s in CONTRACTS],
        "id string, contract_no string, company_id string, rig_id string, start_date date, end_date date, "
        "value_usd decimal(18,2), status string")
    assets = spark.createDataFrame(
        [(ASSET(n), f"AST-{n:03d}", name, cat, COMPANY(c), RIG(r), None, st, Decimal(v))
         for n, name, cat, c, r, st, v in ASSETS],
        "id string, asset_id string, name string, category string, company_id string, rig_id string, "
        "contract_id string, status string, value_usd decimal(18,2)")
    schedules = spark.createDataFrame(
        [(f"S{i}", pm, ASSET(a), tt, f, d(ld), d(nd), ad, pr, st)
         for i, (pm, a, tt, f, ld, nd, ad, pr, st) in enumerate(SCHEDULES, 1)],
        "id string, pm_id string, asset_id string, task_type string, frequency_days int, "
        "last_done_date date, next_due_date date, alert_days int, priority string, status string")
    notices = spark.createDataFrame(
        [(f"N{i}", None, et, None, False, dt.datetime(2025, 1, 1, 0, i)) for i, et in
         enumerate(["contract", "maintenance", None, "asset"], 1)],
        "id string, user_id string, entity_type string, entity_id string, is_read boolean, created_at timestamp")
    users = spark.createDataFrame([(f"U{i}", f"User {i}", r, "Active") for i, r in
                                   enumerate(["Admin", "Asset Manager", "Operations Manager", "Editor",
                                              "Viewer", "Viewer"], 1)],
                                  "id string, full_name string, role string, status string")
    return dict(rigs=rigs, companies=companies, contracts=contracts, assets=assets, schedules=schedules,
                notifications=notices, users=users)
