"""Values that must be as they are for right results: names, identifiers, bounds and formats."""

from __future__ import annotations

# Month names used as sheet names.
MONTH_NUMBERS = {
    "Януари": 1, "Февруари": 2, "Март": 3, "Април": 4, "Май": 5, "Юни": 6,
    "Юли": 7, "Август": 8, "Септември": 9, "Октомври": 10, "Ноември": 11, "Декември": 12,
}

# Hour of day at which a shift is stamped, marker of total rows, sheet columns.
SHIFT_HOURS = {1: 6, 2: 14, 3: 22}
TOTAL_MARKER = "Общо"
DAY_COLUMN = "Дата"
SHIFT_COLUMN = "Смяна"

# Ordered substring rules on the lower-cased header of a shift sheet.
SHIFT_HEADER_RULES = [
    ("class_15", ["+15"]),
    ("class_12", ["+12.5", "+12,5", "+12"]),
    ("grano", ["грано"]),
    ("daiki", ["дайки"]),
    ("shisti", ["шисти"]),
]

# Sheet headers, without line breaks and outer blanks, and their names in the translated table.
SHEET_HEADERS = {
    "Дата": "Date",
    "Смяна": "Shift",
    "Диспечер": "Dispatcher",
    "Подадена руда от МГТЛ за денонощието": "Ore_fed_from_MGTL_per_day",
    "Състояние на склад №2": "State_of_warehouse_2",
    "Натрошена руда от Цех ССТ": "Crushed_ore_from_SST_plant",
    "Класа  +   15,0мм.": "Class_+15.0mm",
    "Класа  +   12,5мм.": "Class_+12.5mm",
    "Превозена руда до междинни бункери": "Ore_transported_to_intermediate_bins",
    "Състояние на междинни бункери": "State_of_intermediate_bins",
    "Преработена руда в цех МФЦ": "Processed_ore_in_MFC_plant",
    "Влага на преработената руда": "Moisture_of_processed_ore",
    "Суха преработена руда": "Dry_processed_ore",
    "Гранодиорити": "Granodiorites",
    "Дайки": "Dikes",
    "Шисти": "Shales",
    "Показания на Гранулометър PSI500i руда, +0,20мм": "PSI500i_granulometer_reading_ore_+0.20mm",
    "Смилане  класа + 0,20мм": "Grinding_class_+0.20mm",
    "Смилане  класа -0,08мм": "Grinding_class_-0.08mm",
    "Плътност на пулпа": "Pulp_density",
    "Съдържание на мед в рудите по Куриер": "Copper_content_in_ores_by_Courier",
    "Метал  мед в рудите по Куриер": "Metal_copper_in_ores_by_Courier",
    "Коригирана съдържание на мед в рудите": "Corrected_copper_content_in_ores",
    "Съдържание на мед в отпадъка по Куриер": "Copper_content_in_waste_by_Courier",
    "Метал мед в отпадъка по Куриер": "Metal_copper_in_waste_by_Courier",
    "Съдържание на медв медния к-т Куриер": "Copper_content_in_copper_concentrate_Courier",
    "Метал мед в концентрата по Куриер": "Metal_copper_in_concentrate_by_Courier",
    "Технологично извличане по Куриер": "Technological_extraction_by_Courier",
    "Товарно извличане": "Cargo_extraction",
    "Добит меден концентрат": "Extracted_copper_concentrate",
    "Влага на медния концентрат": "Moisture_of_copper_concentrate",
    "Съдържание на медв медния к-т": "Copper_content_in_copper_concentrate",
    "Съдържание на медв медния к-т  /химия-товарен/": "Copper_content_in_copper_concentrate_chemistry_cargo",
    "Метал мед в медния концентрат": "Metal_copper_in_copper_concentrate",
    "Метал мед в медния концентрат /химия/": "Metal_copper_in_copper_concentrate_chemistry",
    "Литрово тегло в сгъстителя": "Specific_gravity_in_thickener",
    "Меден концентра, автомобилна везна": "Copper_concentrate_vehicle_scale",
    "Меден концентрат в склад": "Copper_concentrate_in_warehouse",
    "Меден концентрат в склад.1": "Copper_concentrate_in_warehouse_1",
    "Добит молибденов концентрат": "Molybdenum_concentrate_extracted",
    "Съдържание на Мо в молибденовия к-т": "Molybdenum_content_in_molybdenum_concentrate",
    "последни данни за съдържания в 8-ма пречистка": "Latest_data_on_content_in_8th_purification",
    "последни данни за съдържания във 2-ра пречистка": "Latest_data_on_content_in_2nd_purification",
    "TimeStamp": "Timestamp",
    "OriginalSheet": "OriginalSheet",
    "Съдържание на медв медния к-т (Bruker)": "Copper_content_in_copper_concentrate_Bruker",
    "Метал мед в медния концентрат  (Bruker)": "Metal_copper_in_copper_concentrate_Bruker",
    "Класа +15,0мм.": "Class_+15.0mm",
    "Класа  +12,5мм.": "Class_+12.5mm",
    "Смилане  класа     +0,20мм": "Grinding_class_+0.20mm",
    "Смилане  класа      -0,08мм": "Grinding_class_-0.08mm",
    "Съдържание на мед в рудите по Химия": "Copper_content_in_ores_by_Chemistry",
    "Метал  мед в рудите по Химия": "Metal_copper_in_ores_by_Chemistry",
    "Съдържание на медв медния к-т (Брукер)": "Copper_content_in_copper_concentrate_Bruker",
    "Метал мед в медния концентрат (Брукер)": "Metal_copper_in_copper_concentrate_Bruker",
    "Меден концентрат, автомобилна везна": "Copper_concentrate_vehicle_scale",
    "Класа  +15,0мм.": "Class_+15.0mm",
    "Смилане  класа        +0,20мм": "Grinding_class_+0.20mm",
    "Смилане  класа        -0,08мм": "Grinding_class_-0.08mm",
}

# Laboratory measures, and columns kept out of change-point features.
LAB_COLUMNS = ["Class_15", "Class_12", "Grano", "Daiki", "Shisti"]
TARGET_AND_LAB_COLUMNS = ["PSI200", "Class_15", "Class_12", "Grano", "Daiki", "Shisti"]
SUMMARY_FEATURES = ["Ore", "WaterMill", "WaterZumpf", "MotorAmp", "DensityHC", "PressureHC"]

# Sensor features in table order, and the tag of every feature for mills 1 to 12.
MILLS = [f"Mill{n:02d}" for n in range(1, 13)]
FEATURE_TAGS = {
    "Ore": [485, 488, 491, 494, 497, 500, 455, 467, 476, 479, 482, 3786],
    "WaterMill": [560, 580, 530, 1227, 1237, 1219, 461, 474, 509, 517, 522, 3790],
    "WaterZumpf": [561, 581, 531, 1228, 1238, 1220, 462, 475, 510, 518, 523, 3792],
    "Power": [487, 490, 493, 496, 499, 502, 460, 471, 478, 481, 483, 3773],
    "ZumpfLevel": [486, 489, 492, 495, 498, 501, 458, 470, 477, 480, 484, 3747],
    "PressureHC": [558, 578, 528, 1225, 1235, 1217, 459, 472, 507, 515, 2687, 3774],
    "DensityHC": [557, 577, 527, 1224, 1234, 1216, 457, 469, 506, 514, 2658, 3742],
    "FE": [1762, 1762, 1762, 1762, 1762, 1762, 1762, 1762, 1762, 1762, 1762, 1762],
    "PulpHC": [2386, 2160, 2609, 2726, 2217, 2777, 2837, 1833, 2485, 2434, 2670, 3755],
    "PumpRPM": [2405, 2198, 2629, 2745, 1652, 2796, 2856, 1800, 2471, 2452, 2690, 3780],
    "MotorAmp": [2379, 2153, 2602, 2719, 2210, 2770, 2830, 1805, 2478, 2427, 2663, 3748],
    "PSI80": [2379, 2153, 2602, 2719, 2210, 5329, 5331, 5332, 2478, 2427, 2663, 3748],
    "PSI200": [2379, 2153, 2602, 2719, 2210, 5328, 5330, 5333, 2478, 2427, 2663, 3748],
}

# Inclusive physical bounds used as filters, wide and narrow.
WIDE_BOUNDS = {
    "Ore": (150.0, 200.0), "PSI200": (15.0, 35.0), "WaterMill": (5.0, 20.0),
    "WaterZumpf": (140.0, 250.0), "DensityHC": (1500.0, 1800.0), "MotorAmp": (170.0, 220.0),
}
NARROW_BOUNDS = {
    "Ore": (160.0, 200.0), "PSI200": (18.0, 35.0), "WaterMill": (10.0, 20.0),
    "WaterZumpf": (150.0, 250.0), "DensityHC": (1600.0, 1800.0), "MotorAmp": (190.0, 220.0),
}

# Strict limits (low, high), None where open.
REPORT_LIMITS = {"PSI200": (15.0, 35.0), "Ore": (150.0, None)}
TRAINING_LIMITS = {"Ore": (160.0, 200.0), "PSI80": (None, 55.0), "FR200": (None, 30.0)}

# Model inputs and set-point bounds.
MODEL_FEATURES = ["Ore", "WaterMill", "WaterZumpf", "PressureHC", "DensityHC", "MotorAmp", "Shisti", "Daiki"]
SETPOINT_BOUNDS = {
    "Ore": (160.0, 200.0), "WaterMill": (12.0, 18.0), "WaterZumpf": (140.0, 240.0),
    "PressureHC": (0.3, 0.5), "DensityHC": (1500.0, 1900.0), "MotorAmp": (170.0, 220.0),
}

# Parameter labels (id, name, unit).
PARAMETERS = [
    ("Ore", "Разход на руда", "t/h"),
    ("WaterMill", "Вода в мелницата", "m³/h"),
    ("WaterZumpf", "Вода в зумпфа", "m³/h"),
    ("PulpHC", "Пулп в ХЦ", "m³/h"),
    ("MotorAmp", "Ток на елетродвигателя", "A"),
    ("DensityHC", "Плътност на ХЦ", "g/L"),
    ("PressureHC", "Налягане на ХЦ", "bar"),
    ("PumpRPM", "Обороти на помпата", "rev/min"),
    ("Shisti", "Шисти", "%"),
    ("Daiki", "Дайки", "%"),
    ("Grano", "Гранодиорити", "%"),
    ("Class_12", "Клас 12", "%"),
    ("Class_15", "Клас 15", "%"),
    ("PSI80", "Фракция -80 μk", "μk"),
    ("PSI200", "Фракция +200 μk", "μk"),
]

# Penalties tried by default, and the limits of a reasonable segmentation.
PENALTIES = [1.0, 3.0, 5.0, 10.0, 20.0, 30.0, 50.0, 80.0, 120.0, 200.0]
