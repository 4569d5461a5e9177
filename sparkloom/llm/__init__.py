"""Training-data operators: packing, filtering, sharding, language, quality, text extraction and near duplicates."""
