"""trolley: basket and product-catalogue analytics as PySpark DataFrame operators."""
