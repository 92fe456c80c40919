"""Schemas of the tables that the engine works on."""

from __future__ import annotations

VENDOR = "id string, name string, logo string, website string, phone string, email string, address string, city string, latitude double, longitude double"

#: A product row of a vendor, as search and snapshot read it.
PRODUCT = (
    "id string, title string, price double, vendor_id string, vendor_name string, link string, thumbnail string, brand string, normalized_name string, "
    "core string, canonical_identity string, dosage_value double, dosage_unit string, volume_value double, volume_unit string, form string, category string, "
    "quantity double, search_tokens array<string>, updated_at timestamp"
)

#: A row of a vendor's scraped file; the order is the file's.
SNAPSHOT_CSV = "title string, price string, category string, link string, thumbnail string, photos string, vendor string, scraped_at string"

STANDARDIZATION = (
    "title string, original_title string, normalized_name string, brand string, form string, dosage_value double, dosage_unit string, quantity_value int, "
    "quantity_unit string, volume_value double, volume_unit string, confidence double, updated_at timestamp"
)

WATCH = "id string, user_id string, group_key string, display_name string, target_price double, last_price double, last_vendor string"
HISTORY = "group_key string, min_price double, offer_count long, recorded_at timestamp"
ALERT = "watch_id string, user_id string, kind string, old_price double, new_price double, vendor string, sent_at timestamp"

PLACE_CATEGORIES = "array<struct<fsq_category_id: string, id: string, name: string>>"
PLACE_PHOTOS = "array<struct<id: string, prefix: string, suffix: string, url: string, width: int, height: int>>"
PLACE = (
    "id string, vendor_id string, vendor_name string, source string, source_id string, name string, address string, locality string, formatted_address string, "
    f"phone string, hours string, latitude double, longitude double, rating double, popularity double, categories {PLACE_CATEGORIES}, photos {PLACE_PHOTOS}, fetched_at timestamp"
)
