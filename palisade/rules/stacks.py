"""Dependency names that identify a framework.  Fixed values, in catalogue order."""

from __future__ import annotations

JS_STACKS: dict[str, tuple[str, ...]] = {
    "Next.js": ("next", "next.js"),
    "Vite": ("vite", "@vitejs/plugin-react", "@vitejs/plugin-vue"),
    "React": ("react", "react-dom"),
    "Vue": ("vue", "@vue/core", "@vue/runtime-core"),
    "Svelte": ("svelte", "@sveltejs/kit", "svelte-kit"),
    "Nuxt": ("nuxt", "@nuxt/core", "nuxt3"),
    "Astro": ("astro",),
    "Remix": ("@remix-run/react", "@remix-run/node", "@remix-run/serve"),
    "Angular": ("@angular/core", "@angular/cli"),
    "Solid": ("solid-js",),
    "Qwik": ("@builder.io/qwik",),
    "Express": ("express",),
    "Fastify": ("fastify",),
    "Hapi": ("@hapi/hapi",),
    "Nest.js": ("@nestjs/core",),
    "Sails.js": ("sails",),
    "Strapi": ("@strapi/strapi",),
    "Directus": ("directus",),
    "Payload": ("payload",),
    "Electron": ("electron",),
    "Expo": ("expo", "react-native"),
    "Gatsby": ("gatsby",),
    "Nuxt Bridge": ("@nuxtjs/composition-api",),
    "SvelteKit": ("@sveltejs/kit",),
    "Tanstack": ("@tanstack/router", "@tanstack/start"),
    "tRPC": ("@trpc/server", "@trpc/client"),
    "GraphQL": ("graphql", "apollo-server", "@apollo/server"),
    "Prisma": ("prisma", "@prisma/client"),
    "Drizzle": ("drizzle-orm", "drizzle-kit"),
}

PHP_STACKS: dict[str, tuple[str, ...]] = {
    "Laravel": ("laravel/framework",),
    "Symfony": ("symfony/framework-bundle",),
    "WordPress": ("wordpress/wordpress",),
    "CakePHP": ("cakephp/cakephp",),
    "CodeIgniter": ("codeigniter4/framework",),
}

# substring of requirements.txt or pyproject.toml
PYTHON_STACKS: dict[str, str] = {
    "Django": "django", "Flask": "flask", "FastAPI": "fastapi", "Tornado": "tornado",
    "Starlette": "starlette", "Litestar": "litestar", "Sanic": "sanic", "Streamlit": "streamlit",
    "Gradio": "gradio",
}

# any of these at the root makes a directory a project
PROJECT_FILES: tuple[str, ...] = (
    "package.json", "requirements.txt", "pyproject.toml", "composer.json", "go.mod", "Cargo.toml",
    "pom.xml", "build.gradle",
)
PORT_SCRIPTS: tuple[str, ...] = ("dev", "start", "serve", "preview")
PORT_PATTERN = r"(?:-p|--port|PORT=)\s*(\d{4,5})"
