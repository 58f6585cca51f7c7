from setuptools import setup

setup(
    name="ignored",
    install_requires=["left-out"],
    entry_points={"gui_scripts": ["window = shop.gui:show"]},
)
