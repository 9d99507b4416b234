"""Fixed values that results depend on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product categories that are used up or worn out soon.
NON_DURABLE_CATEGORIES = [
    "health_beauty", "perfumery", "food_drink", "food", "drinks",
    "diapers_and_hygiene", "baby", "stationery", "party_supplies",
    "christmas_supplies", "flowers", "arts_and_craftmanship",
    "books_general_interest", "books_technical", "books_imported",
    "fashion_male_clothing", "fashio_female_clothing",
    "fashion_childrens_clothes", "fashion_underwear_beach", "fashion_sport",
    "fashion_shoes", "fashion_bags_accessories", "pet_shop", "toys",
    "sports_leisure", "la_cuisine",
]

# Product categories bought to last.
DURABLE_CATEGORIES = [
    "art", "bed_bath_table", "furniture_decor", "computers_accessories",
    "housewares", "watches_gifts", "telephony", "cool_stuff", "garden_tools",
    "auto", "electronics", "office_furniture", "consoles_games",
    "small_appliances", "home_appliances", "home_appliances_2",
    "tablets_printing_image", "audio", "fixed_telephony", "air_conditioning",
    "computers", "cine_photo", "music", "musical_instruments",
    "cds_dvds_musicals", "dvds_blu_ray", "luggage_accessories",
    "furniture_bedroom", "furniture_living_room",
    "furniture_mattress_and_upholstery",
    "kitchen_dining_laundry_garden_furniture", "home_construction",
    "home_confort", "home_comfort_2", "construction_tools_construction",
    "costruction_tools_garden", "costruction_tools_tools",
    "construction_tools_lights", "construction_tools_safety",
    "signaling_and_security", "agro_industry_and_commerce",
    "industry_commerce_and_business", "security_and_services",
    "small_appliances_home_oven_and_coffee", "market_place",
]

CATEGORY_DURABILITY: dict[str, int] = dict.fromkeys(NON_DURABLE_CATEGORIES, 0) | dict.fromkeys(
    DURABLE_CATEGORIES, 1
)

# Polarity of a review rating, and the names of the polarities.
RATING_POLARITY = {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
POLARITY_NAMES = ["negative", "neutral", "positive"]

# Delivery bins by days of slack, as upper edges (right-closed) and labels.
DELIVERY_EDGES = [-1, 4, 9, 14]
DELIVERY_LABELS = [
    "late", "0 to 4 days early", "5 to 9 days early", "10 to 14 days early",
    "15 or more days early",
]

QUARTILE_LABELS = ["Q1 (lowest)", "Q2", "Q3", "Q4 (highest)"]

# The ten inputs of the tree models, in table order, with readable names. The report
# tables of a study use them.
TREE_FEATURES = {
    "first_value": "First purchase value",
    "slack_days": "Delivery slack (days)",
    "late_flag": "Late delivery (yes/no)",
    "state_code": "Customer state",
    "purchase_month": "Month of first purchase",
    "durable": "Durable product",
    "rating": "Review rating",
    "has_text": "Review with text",
    "sent_neg": "Negative sentiment",
    "sent_pos": "Positive sentiment",
}

# Feature blocks that the ablation removes, because its table is read by block.
FEATURE_BLOCKS = {
    "purchase value": ["first_value"],
    "delivery": ["slack_days", "late_flag"],
    "state": ["state_code"],
    "month": ["purchase_month"],
    "durability": ["durable"],
    "rating": ["rating"],
    "text": ["has_text", "sent_neg", "sent_pos"],
}

# Features whose rank correlation with their attribution has no meaning, a code and
# values that are zero without text.
UNSIGNED_FEATURES = ["state_code", "has_text", "sent_neg", "sent_pos"]

# Blocks that are also removed together: what a review says, by stars or in words.
JOINT_BLOCKS = {"review (rating and text)": ["rating", "text"]}


def lookup(key: Column, mapping: dict, default: object = None) -> Column:
    """Value of a small fixed mapping, as one literal map."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))
