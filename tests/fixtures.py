"""Small source trees with known entities."""

SAMPLE = {
    "shop/__init__.py": "",
    "shop/stock/__init__.py": "",
    "shop/till.py": 'def ring(total):\n    """Ring up a sale."""\n    return receipt(round(total))\n\n\ndef receipt(total):\n    """Paper receipt."""\n    return total\n',
    "shop/stock/shelf.py": (
        'class Shelf:\n    """Boards that carry goods."""\n\n'
        '    def put(self, item: str, pieces: int) -> int:\n        """Put pieces away."""\n        return pieces\n\n'
        '    def take(self, item: str, pieces: int) -> int:\n        """Take pieces down."""\n        return -pieces\n\n\n'
        'def price_tag(cents):\n    """Print cents nicely."""\n    return str(cents)\n\n\n'
        'async def order_goods(url: str) -> str:\n    """Order from a wholesaler."""\n    return url\n'
    ),
}
GOODS = {
    "shop/__init__.py": "",
    "shop/goods.py": (
        "class Ware:\n    def weigh(self):\n        pass\n\n    def wrap(self):\n        pass\n\n\n"
        "class Fruit(Ware):\n    def ripen(self):\n        pass\n\n\nclass Apple(Fruit):\n    def peel(self):\n        pass\n\n\n"
        "class Bread(Ware):\n    pass\n\n\nclass Cheese(Ware):\n    pass\n"
    ),
}


def files(spark, sources):
    rows = [(p, s.encode() if isinstance(s, str) else s) for p, s in sources.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def nodes(spark, rows):
    """rows: (id, parent_id, name, type, calls, base_classes)."""
    full = [(i, p, n, t, None, None, None, None, None, c, b, "python") for i, p, n, t, c, b in rows]
    from treeloom.schemas import NODES

    return spark.createDataFrame(full, NODES)
